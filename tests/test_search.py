"""The search plan against a plain loop, and its physical plan."""

import math
import random
from collections import Counter

import pytest

from namelode.operators import search as S
from namelode.operators.index import index_of
from namelode.session import configure
from namelode.sources.requests import query_rows

DOCS = "doc_seq long, domain_exact string, label string, tld string, len int, has_hyphen boolean, tokens array<string>"


def by_loop(docs, q, tld, limit, min_match):
    tokens = q.lower().split()
    if not tokens:
        return []
    n, avgdl = len(docs), sum(len(d[6]) for d in docs) / len(docs)
    df = Counter(t for d in docs for t in set(d[6]))
    found = []
    for d in docs:
        tf, score = Counter(d[6]), 0.0
        if not any(t in tf for t in tokens):
            continue
        for t in tokens:
            if t in tf:
                score += math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(d[6]) / avgdl))
        found.append((round(score, 6), d))
    found.sort(key=lambda x: (-x[0], x[1][0]))
    kept, perfect = [], 0
    for score, d in found[: min(limit * (20 if len(tokens) == 1 else 50), 1000 if tld is None else 3000)]:
        count = sum(t in d[6] for t in tokens)
        if count < min_match or (tld is not None and d[3] != tld.lower()):
            continue
        kept.append((count, d, score))
        perfect += count == len(tokens)
        if perfect >= 2 * limit:
            break
    order = lambda x: (-x[0], x[1][4], -x[2])
    sides = [sorted((x for x in kept if x[1][5] == h), key=order) for h in (True, False)]
    out, i = [], 0
    while len(out) < limit and (i < len(sides[0]) or i < len(sides[1])):
        out += [side[i] for side in sides if i < len(side)]
        i += 1
    return [(x[1][0], x[0], x[2], len(kept)) for x in out[:limit]]


@pytest.mark.parametrize("seed", range(3))
def test_against_a_loop(spark, seed):
    configure(spark)
    rng = random.Random(seed)
    words = ["red", "gear", "bolt", "cap", "pin"]
    docs = []
    for i in range(150):
        tokens = [rng.choice(words) for _ in range(rng.randint(0, 4))]
        label = rng.choice(["-", ""]).join(tokens) or "none"
        docs.append((i, f"{label}.x", label, rng.choice(["com", "net", ""]), len(label), "-" in label, tokens))
    queries = [(k, " ".join(rng.choice(words + ["zz"]) for _ in range(rng.randint(0, 3))), rng.choice([None, None, "COM", ""]), rng.choice([1, 2, 3, 10]), rng.choice([0, 1, 2])) for k in range(12)]
    got = {}
    for r in S.search(query_rows(spark, queries), index_of(spark.createDataFrame(docs, DOCS))).collect():
        got.setdefault(r["qid"], {})[r["pos"]] = (r["domain"], r["match_count"], r["score"], r["total_candidates"])
    for qid, q, tld, limit, least in queries:
        want = by_loop(docs, q, tld, limit, least)
        assert [got.get(qid, {}).get(i + 1) for i in range(len(want))] == [(docs[d][1], m, pytest.approx(s, abs=2e-6), n) for d, m, s, n in want], (q, tld, limit, least)
        assert len(got.get(qid, {})) == len(want)


def test_plan_cuts_by_rank_before_the_domain(spark):
    configure(spark)
    docs = spark.createDataFrame([(1, "a.com", "a", "com", 1, False, ["a"])], DOCS)
    plan = S.search(query_rows(spark, [(0, "a", "com", 5, None)]), index_of(docs))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
