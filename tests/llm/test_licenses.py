"""License passages: repeated lines in time, and passages inside lines against a plain version, in the registered query too."""

import random
import re
import time

import pytest

from tidemark.llm import licenses
from tidemark.llm.queries import QUERIES

D = "/root/testdata/sf0.001"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
lower = lambda t: "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in t)


@pytest.fixture(scope="module")
def templates():
    return licenses.Templates(licenses.TEMPLATES, licenses.LEAST)


def test_repeated_lines(templates):
    began = time.time()
    found = licenses.matches([b"Licensed under CC BY 4.0.\n" * 40_000], templates, inside=True)
    assert time.time() - began < 8 and len(found[0]) >= 40_000
    assert len(licenses.matches([b"licensed under the mit license and more words here " * 8000], templates, inside=True)[0]) == 8000


def plain(text, least=licenses.LEAST):
    """(license, first word, words) of every match, by loops over words, templates and starts."""
    spans = [(m.start(), m.end()) for m in re.finditer(WORD, lower(text))]
    words = [lower(text)[a:b] for a, b in spans]
    line = [text.count("\n", 0, a) for a, _ in spans]
    pairs = list(zip(words, words[1:], strict=False))
    para, k = [], -1
    for i, x in enumerate(line):
        k += i == 0 or x > line[i - 1] + 1
        para.append(k)
    own = [(name, re.findall(WORD, lower(t))) for name in sorted(licenses.TEMPLATES) for t in licenses.TEMPLATES[name]]
    bigrams = [set(zip(w, w[1:], strict=False)) for _, w in own]
    anyone = set().union(*bigrams)
    out = {}
    for level in (line, para, [0] * len(words)):
        for p in sorted(set(level)):
            at = [i for i, x in enumerate(level) if x == p]
            have = {pairs[i] for i in at[:-1]}
            if not have & anyone:
                continue
            for (name, _), b in zip(own, bigrams, strict=True):
                if b and 2 * len(have & b) / (len(have) + len(b)) >= least:
                    out[name, at[0], at[-1] + 1] = True
    for t in sorted(range(len(own)), key=lambda t: -(len(own[t][1]) - 1)):
        name, length, b = own[t][0], len(own[t][1]) - 1, bigrams[t]
        need = -int(-(len(b) * least / (2 - least) - 1e-9) // 1)
        spot = [i for i, x in enumerate(pairs) if x in b]
        runs = []
        for n, i in enumerate(spot[: max(0, len(spot) - need + 1)] if need else []):
            if spot[n + need - 1] - i >= length:
                continue
            j = max(x for x in spot if x < min(i + length, len(words) - 1))
            have = set(pairs[i : j + 1])
            dice = 2 * len(have & b) / (len(have) + len(b))
            if dice >= least:
                runs.append((-dice, i, j + 2))
        for _, a, z in sorted(runs):
            if all(n != name or x >= z or y <= a for n, x, y in out):
                out[name, a, z] = True
    return sorted(out)


@pytest.mark.parametrize("seed", range(30))
def test_passages_against_a_plain_version(templates, seed):
    rng = random.Random(seed)
    every = [t for x in licenses.TEMPLATES.values() for t in x]
    parts = []
    for _ in range(rng.randrange(1, 7)):
        w = rng.choice(every).split()[:60]
        w = w[rng.randrange(3) :]
        if rng.random() < 0.5 and len(w) > 4:
            w[rng.randrange(len(w))] = "zzz"
        parts += w + ["filler"] * rng.randrange(6) + ["\n"] * rng.randrange(3)
    text = " ".join(parts)
    got = licenses.matches([b"", text.encode()], templates, inside=True).get(1, [])
    assert sorted((m["license"], m["first_word"], m["first_word"] + m["n_words"]) for m in got) == plain(text)


def test_the_registered_query(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{D}/documents.parquet").collect()}
    rows = {r.doc_id: (r.licenses, r.n_passages) for r in QUERIES["op9_license_scan"](spark, D).collect()}
    assert rows.keys() == docs.keys()
    hint = re.compile(r"licen[sc]e|copyright|redistribut|permission|warrant|public domain|creative|©", re.I)
    some = [i for i, t in docs.items() if hint.search(t) and len(t) < 40_000]
    want = {i: plain(docs[i]) for i in some}
    assert {i: rows[i] for i in some} == {i: (",".join(sorted({m[0] for m in x})), len(x)) for i, x in want.items()} and any(want.values())
