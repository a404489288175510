import re

import numpy as np
import pytest

from quantaloom.llm import licenses


def judge(text):
    """The same model, applied in plain Python: the family that stands, or None."""
    weights, bias, temperature, bound, _ = licenses.model()
    tokens = licenses.words(text)
    pairs = set(zip(tokens, tokens[1:], strict=False))
    met = [(family, len(own), [p for p in own if tuple(p.split(" ")) in pairs]) for family, own in licenses.templates()]
    confirmed = {family for family, n, found in met if len(found) >= licenses.CONFIRM * n and any(map(licenses._anchored, found))}
    scores = bias + sum(weights[b] for b in {licenses._bucket(g) for g in licenses.grams(tokens)})
    p = np.exp((scores - scores.max()) / temperature)
    p /= p.sum()
    family = licenses.FAMILIES[int(p.argmax())]
    return family if family != licenses.UNKNOWN and p.max() >= bound and family in confirmed else None


def brute(text):
    """Every line and every wrapped notice, without the gate of anchors."""
    lines = (text or "").split("\n")
    alone = {i: f for i, line in enumerate(lines) if (f := judge(line))}
    found, last = dict(alone), {}
    for i, line in enumerate(lines):
        if licenses.ANCHOR_SET.isdisjoint(licenses.words(line)):
            continue
        part = lines[i : i + licenses.JOIN]
        part = part[: next((k for k, x in enumerate(part) if not re.search(r"\S", x)), len(part))]
        family = judge(" ".join(part))
        if family and not any(j in alone for j in range(i, i + licenses.JOIN)):
            if i - last.get(family, -9) >= licenses.JOIN:
                found[i] = family
            last[family] = i
    return [f"{found[i]}:{i}" for i in sorted(found)]


def test_held_out_accuracy_and_calibration():
    _, _, temperature, bound, accuracy = licenses.model()
    assert accuracy >= 0.9
    assert 0.06 < temperature < 19 and 0 < bound < 0.99


def test_gate_loses_nothing():
    for family, pairs in licenses.templates():
        assert any(map(licenses._anchored, pairs)), (family, pairs)
    # the gate reads whole texts by a pattern, the model reads words
    for text in ("GPLv3", "x-LGPLv2.1", "cc0", "(apache)", "AGPLv3"):
        assert not licenses.ANCHOR_SET.isdisjoint(licenses.words(text))


TEXTS = [
    ("Licensed under the Apache License, Version 2.0.\nSome prose.", ["Apache:0"]),
    ("x\nReleased under the MIT License.", ["MIT:1"]),
    ("This work is licensed under the GNU General Public License, version 3.", ["GPL:0"]),
    ("Licensed under CC BY-NC 4.0.\nLicensed under CC BY 4.0.", ["CC-BY-NC:0", "CC-BY:1"]),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software", ["MIT:0"]),
    ("My license plate and my driver's license were lost.\nWe met at MIT in May.", []),
    ("Er kam mit dem Rad und mit der Lizenz.\nMit Lizenz.", []),
    ("Released under GPLv3.", ["GPL:0"]),
    ("Released under the Unlicense", ["Unlicense:0"]),
    ("Licensed under the ISC License", ["ISC:0"]),
    ("License: MIT", ["MIT:0"]),
    ("Eclipse Public License v1.0\n\nzlib License\nCC BY-ND 4.0", ["EPL:0", "zlib:2", "CC-BY-ND:3"]),
    ("Redistribution and use in source and binary forms, with or without modification,\nare permitted provided that the following conditions\nare met", ["BSD:0"]),
    ("", []),
    (None, []),
    ("license " * 5000, []),
    ("word " * 40_000 + "released under the MIT License", ["MIT:0"]),
]


def test_against_plain_python(spark):
    rows = [(i, t) for i, (t, _) in enumerate(TEXTS)] + [(1000 + i, t) for i, (_, t, _) in enumerate(licenses.sample()[::9])]
    docs = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], "doc_id long, text string, _lines int, units int, row int")
    got = {r["doc_id"]: r["licenses"] for r in licenses.report(docs).collect()}
    for i, (_, want) in enumerate(TEXTS):
        assert got[i] == ",".join(want), TEXTS[i]
    assert got == {i: ",".join(brute(t)) for i, t in rows}


@pytest.mark.parametrize("rows", [[], [(None, "Released under the MIT License."), (1, None), (1, None)]])
def test_edges(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = licenses.report(docs).collect()
    assert len(out) == len(rows) and sum(r["n_licenses"] for r in out) == (1 if rows else 0)
