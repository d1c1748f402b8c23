import re

from glimmer.llm import licenses

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
TEXTS = [
    "Licensed under CC BY-NC 4.0.",
    "This work is licensed under the GNU General Public License, version 3. GNU GENERAL PUBLIC LICENSE again",
    "all rights\nreserved; all  rights... reserved! by the rights reserved",
    "the licence of the general public; cc, not by",
    "Released under the MIT License.",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "person obtaining a licence",
    "Licensed under the Apache License, Version 2.0.",
    "plain prose of no licence at all and all of the by and general things",
]


def brute(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hits = [(i, label) for p, label in licenses.BASE_PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    return len(w), sorted(hits)


def test_base_places_and_templates(documents, awkward):
    texts = TEXTS + awkward
    got = {r["doc_id"]: r for r in licenses.scan_licenses(documents(texts)).collect()}
    for i, t in enumerate(texts):
        n, hits = brute(t)
        assert got[i]["n_words"] == n and [(p["p"], p["label"]) for p in got[i]["places"]] == hits and 0 <= got[i]["score"] <= 1
    labels = [{f["label"] for f in got[i]["found"]} for i in range(len(TEXTS))]
    assert labels == [{"cc-by-nc"}, {"gpl"}, set(), set(), {"mit"}, {"mit"}, set(), {"apache-2.0"}, set()]
    assert got[4]["score"] >= 0.5 and got[8]["score"] == 0


def test_empty_and_repeated(documents):
    assert licenses.scan_licenses(documents([])).count() == 0
    rows = licenses.scan_licenses(documents([TEXTS[4]] * 3, [1, 1, None])).collect()
    assert len(rows) == 3 and all(len(r["found"]) == 1 for r in rows)


def brute_templates(texts, coverage=0.5):
    """Every template at every place of every text, by plain loops."""
    import math

    words = [WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in texts]
    rare = {w for t in licenses.TEMPLATES for w in t.text.split()} - licenses.PLAIN
    idf = {w: round(math.log((len(texts) + 1) / (sum(w in x for x in words) + 1)) + 1, 6) for w in rare}
    out = []
    for text in words:
        found = {}
        for t in licenses.TEMPLATES:
            own, key = t.text.split(), t.key.split()
            at = next(i for i in range(len(own)) if own[i : i + len(key)] == key)
            total = sum(idf.get(w, 0) for w in own)
            for start in range(-len(own) + 1, len(text)):
                if text[max(start + at, 0) : start + at + len(key)] != key:
                    continue
                score = sum(idf.get(w, 0) for i, w in enumerate(own) if 0 <= start + i < len(text) and text[start + i] == w) / total
                if score >= coverage - 1e-9:
                    found[t.label, max(start, 0)] = max(score, found.get((t.label, max(start, 0)), 0))
        out.append({k: round(v, 6) for k, v in found.items()})
    return out


def test_templates_equal_brute_force(documents):
    whole = [licenses.MIT, licenses.ISC, licenses.BSD + " " + licenses.BSD_DISCLAIMER, licenses.APACHE, licenses.GPL, licenses.MPL, licenses.ZLIB, licenses.UNLICENSE]
    cut = [" ".join(w for k, w in enumerate(t.split()) if k < len(t.split()) * share) for t in whole for share in (0.3, 0.55, 0.9)]
    texts = [*TEXTS, *whole, *cut, "x " + " y ".join(whole), "// SPDX-License-Identifier: MIT", "SPDX-License-Identifier: Apache-2.0 OR GPL-3.0", None, ""]
    got = {r["doc_id"]: {(f["label"], f["start"]): round(f["score"], 6) for f in r["found"]} for r in licenses.scan_licenses(documents(texts)).collect()}
    for i, want in enumerate(brute_templates(texts)):
        assert got[i].keys() == want.keys() and all(abs(got[i][k] - v) < 1e-5 for k, v in want.items()), texts[i]
    labels = [{k[0] for k in got[i]} for i in range(len(TEXTS), len(TEXTS) + len(whole))]
    assert labels == [{"mit"}, {"isc"}, {"bsd"}, {"apache-2.0"}, {"gpl"}, {"mpl-2.0"}, {"zlib"}, {"unlicense"}]
    assert {k[0] for k in got[len(texts) - 4]} == {"mit"} and {k[0] for k in got[len(texts) - 3]} == {"apache-2.0"}


def test_several_notices_in_one_text(documents):
    text = {t.label: t.text for t in reversed(licenses.TEMPLATES)}
    several = [("bsd", "isc", "mit"), ("apache-2.0", "bsd", "mit", "mpl-2.0"), tuple(sorted(text))]
    rows = licenses.scan_licenses(documents([". Plain prose. ".join(text[x] for x in labels) for labels in several] + [t.text for t in licenses.TEMPLATES])).collect()
    found = {r["doc_id"]: {f["label"] for f in r["found"]} for r in rows}
    for i, labels in enumerate(several):
        assert set(labels) <= found[i]
    # A whole notice has the whole score, beside the others as alone.
    whole = {r["doc_id"]: {f["label"] for f in r["found"] if f["score"] > 1 - 1e-9} for r in rows}
    assert whole[2] == set(text) and all(t.label in whole[3 + i] for i, t in enumerate(licenses.TEMPLATES))
