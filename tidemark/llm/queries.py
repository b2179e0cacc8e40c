"""The queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from . import chat, decontaminate, infill, kneser_ney, licenses, media, minhash, packing, sharding, substring_dedup, toxicity, vectors, warc

QUERIES = {
    "op1_sampled_splitters": sharding.op1,
    "op2_lossless_webp": media.op2,
    "op3_nnpu_toxicity": toxicity.op3,
    "op4_suffix_array_decontamination": decontaminate.op4,
    "op5_kneser_ney_quality": kneser_ney.op5,
    "op6_bbit_minhash": minhash.op6,
    "op7_warc_index_first": warc.op7,
    "op8_minimum_bin_slack": packing.op8,
    "op9_license_scan": licenses.op9,
    "op10_substring_dedup": substring_dedup.op10,
    "op11_delta_lloyd": vectors.op11,
    "op12_fill_in_middle": infill.op12,
    "op13_reply_trees": chat.op13,
}

ORACLES: dict[str, str] = {"op7_warc_index_first": warc.OP7_SQL, "op11_delta_lloyd": vectors.OP11_SQL, "op12_fill_in_middle": infill.OP12_SQL, "op13_reply_trees": chat.OP13_SQL}
