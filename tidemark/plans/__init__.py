"""The library's queries by name, and the SQL that each is held against."""

from . import agreement, chart, concepts, contracts, definitions, disclosures, evaluation, feature_row, judgement, live, outcomes, paths, reading, records, reports, roundtrips, selection, series, streams, technical  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401

#: Names under which a query was known before it took the place of a narrower one.
for _name, _query in (("redaction_whole", "redaction"), ("title_line_classify", "title_classify"), ("near_miss_line_pairs", "near_miss_pairs"), ("near_miss_line_members", "near_miss_members")):
    QUERIES[_name], ORACLES[_name] = QUERIES[_query], ORACLES[_query]
