"""The bootstrapping of personal data against plain Python."""

import collections
import math
import os
import random

import pytest

from palimpsest.llm import pii


def brute_scored(edges, rounds, support, confidence):
    """The found values of ``{(kind, pattern, value): seed}``."""
    seeds = {(k, v) for (k, _, v), seed in edges.items() if seed}
    found = dict.fromkeys(seeds, 1.0)
    for _ in range(rounds):
        sums, members, doubt = collections.Counter(), collections.defaultdict(list), collections.defaultdict(float)
        for k, p, v in edges:
            members[k, p].append(v)
        for (k, p), values in members.items():
            scores = [found[k, v] for v in values if (k, v) in found]
            share = sum(scores) / (len(values) + 1)
            if share >= confidence and len(scores) >= support[p.split(" ")[0]]:
                sums[k, p] = share
        for k, p, v in edges:
            if (k, p) in sums:
                doubt[k, v] += math.log(1 - sums[k, p])
        found = dict.fromkeys(seeds, 1.0) | {x: 1 - math.exp(d) for x, d in doubt.items() if x not in seeds and 1 - math.exp(d) >= confidence}
    return found


@pytest.mark.parametrize("limit", [0, 1000])
def test_scores(spark, monkeypatch, limit):
    monkeypatch.setattr(pii, "BROADCAST_ROWS", limit)
    r, support = random.Random(4), {"before": 2, "word": 5}
    edges = {}
    for value in range(120):
        sure = r.random() < 0.9
        for _ in range(r.randint(1, 4)):
            edges[r.randrange(2), r.choice(("before a", "before b", "word c", "word d", "before rare")), str(value)] = sure
    rows = [(k, p, v, seed) for (k, p, v), seed in edges.items()]
    df = spark.createDataFrame(rows, "kind int, pattern string, value string, seed boolean")
    for confidence in (0.7, 0.85):
        got = {(x.kind, x.value): x.score for x in pii.scored(df, 3, support, confidence).collect()}
        want = brute_scored(edges, 3, support, confidence)
        assert set(got) == set(want) and all(got[x] == pytest.approx(want[x]) for x in want)
    assert len(want) > len({x for x in want if want[x] == 1.0})


def test_forms_find_what_base_patterns_fail_on(spark):
    rows = [(i, f"word{'abcdefghij'[i % 10]} one +1 ({200 + i}) 555-{1000 + i} two") for i in range(40)]
    rows += [(100, "see +1 (999) 555-4081 190.137.223.20 there"), (101, "see 9999999999999 there"), (102, None), (102, ""), (None, "x +1 (998) 555-4081 44444444444 y")]
    got = {r.doc_id: r for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[100].n_phone, got[100].n_ip, got[100].spans, got[100].n_added) == (0, 1, "ip:22:36,phone:4:21", 1)
    assert got[None].spans == "phone:2:19" and got[101].n_added == 0 and got[102].spans == ""


def test_bracketed_addresses(spark):
    rows = [(i, f"from 10.0.{i}.{i + 1} and me{i}@mail.example.org") for i in range(40)]
    rows += [(100, "try 10[.]1[.]2[.]3 or joe[at]mail.example.org"), (101, "steps 1. 2. 3. 4 then 10[.]900[.]2[.]3")]
    got = {r.doc_id: r for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100].spans == "email:22:45,ip:4:18" and got[101].spans == ""


def test_hard_texts():
    for text in ("1 " * 50_000, "1.2.3.4," * 20_000, "@" * 50_000, ":" * 50_000, "+1 23 " * 20_000, "1 . " * 20_000, "a" * 200_000 + "@x.org"):
        base = pii.base_spans(text)
        loose = pii.loose_spans(text, base)
        assert len(pii.patterns_of(text, [*base, *loose])) == len(base) + len(loose)
        taken = [x for _, a, b in base for x in (a, b)]
        assert not taken or all(b <= taken[0] or a >= taken[-1] or not any(c < b and a < d for _, c, d in base) for _, a, b in loose[:50])


def test_overlaps():
    spans = [dict(kind=3, start=0, end=5, score=0.9), dict(kind=2, start=3, end=9, score=0.95), dict(kind=2, start=9, end=12, score=0.9), dict(kind=3, start=9, end=12, score=0.9)]
    assert [(x["kind"], x["start"], x["end"]) for x in pii._apart(spans)] == [(2, 3, 9), (2, 9, 12)]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no driver tables")
def test_the_tables_have_unseen_ones(spark):
    """Numbers that run into another one are not base spans; no number with a wrong check digit is taken."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    found = pii.report(docs).where("n_added > 0").join(docs, "doc_id").collect()
    added = [(kind, r.text[int(a) : int(b)]) for r in found for kind, a, b in (x.split(":") for x in r.spans.split(",")) if (pii.KINDS.index(kind), int(a), int(b)) not in pii.base_spans(r.text)]
    assert {kind for kind, _ in added} == {"card", "phone"}
    assert all(pii.luhn(x) if kind == "card" else pii.form_of(pii.PHONE, x) == "+0 (000) 000-0000" for kind, x in added)
