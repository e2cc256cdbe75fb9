"""The pipeline's stages, each against brute force on its own input."""

import hashlib
from collections import Counter, defaultdict

import pytest
from test_contracts import WORD, simhash

import corpus_pipeline as p
from seqgraph.llm import compression_quality, sentencepiece_viterbi
from seqgraph.llm.common import staged, table
from seqgraph.llm.queries import MIX_SEED, WEIGHTS, source_domain, tokenizer_file


@pytest.fixture(scope="module")
def stages(spark, small):
    docs = table(spark, small, "documents")
    out = [docs]
    for name, stage in p.STAGES:
        docs = staged(stage(spark, docs, small), name.replace(" ", "-"))
        out.append(docs)
    return out


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_columns(stages):
    assert [n for n, _ in p.STAGES] == ["quality classifier", "simhash near-dedup", "substring dedup", "mixing", "sentencepiece"]
    for df in stages[:5]:
        assert set(df.columns) == set(p.COLUMNS)
    assert {"doc_id", "ids"} <= set(stages[5].columns) and stages[5].count() > 0


def test_quality(spark, small, stages):
    model = compression_quality.fit(stages[0], table(spark, small, "labels"))
    scores = rows(compression_quality.score(stages[0], model))
    assert set(rows(stages[1])) == {d for d, r in scores.items() if r["score"] >= 0.3}


def test_near_duplicates(stages):
    before, after = rows(stages[1]), rows(stages[2])
    prints = sorted((d, simhash(r["text"])) for d, r in before.items())
    kept, group = set(), {}
    for d, x in prints:
        near = {group[e] for e, y in prints if e in group and (x ^ y).bit_count() <= 3}
        root = min(near | {d})
        group |= {e: root for e, g in group.items() if g in near} | {d: root}
    kept = set(group.values())
    assert set(after) == kept and all(after[d] == before[d] for d in kept)


def test_repeats(stages):
    before, after = rows(stages[2]), rows(stages[3])
    words = {d: WORD.findall(r["text"] or "") for d, r in before.items()}
    seen = Counter(tuple(w[i : i + 35]) for w in words.values() for i in range(len(w) - 34))
    assert set(before) == set(after)
    for d, w in words.items():
        drop = [False] * len(w)
        for i in range(len(w) - 34):
            if seen[tuple(w[i : i + 35])] > 1:
                drop[i : i + 35] = [True] * 35
        assert WORD.findall(after[d]["text"] or "") == [x for x, y in zip(w, drop) if not y]
        if not any(drop):
            assert after[d] == before[d]
        else:
            assert after[d]["n_chars"] == len(after[d]["text"])


def test_mixture(stages):
    domains = {r["doc_id"]: r["domain"] for r in stages[3].select("doc_id", source_domain().alias("domain")).collect()}
    docs = {d: (domains[d], r["lang"], r["source"], len(WORD.findall(r["text"] or ""))) for d, r in rows(stages[3]).items()}
    sizes = defaultdict(int)
    for *leaf, n in docs.values():
        sizes[tuple(leaf)] += n

    def below(prefix):
        return sum(n for leaf, n in sizes.items() if leaf[: len(prefix)] == prefix)

    def fill(prefix, budget):
        """Water filling by repeated rounds: full children leave, the rest share what is left by weight."""
        if len(prefix) == 3:
            return {prefix: int(budget + 1e-6)}
        level = ("domain", "lang", "source")[len(prefix)]
        open_ = {leaf[: len(prefix) + 1] for leaf in sizes if leaf[: len(prefix)] == prefix}
        given = {}
        while open_:
            weight = {c: WEIGHTS[level].get(c[-1], 1.0) for c in open_}
            share = {c: budget * weight[c] / sum(weight.values()) for c in open_}
            full = {c for c in open_ if below(c) <= share[c]}
            if not full:
                given |= share
                break
            given |= {c: float(below(c)) for c in full}
            budget -= sum(below(c) for c in full)
            open_ -= full
        return {k: v for c, b in given.items() for k, v in fill(c, b).items()}

    allotted, taken = fill((), float(int(sum(sizes.values()) * p.MIX_FRACTION))), set()
    for leaf, tokens in allotted.items():
        mine = sorted((hashlib.md5(f"{MIX_SEED}:1:{d}".encode()).hexdigest(), d) for d, r in docs.items() if r[:3] == leaf)
        for _, d in mine:
            tokens -= docs[d][3]
            if tokens < 0:
                break
            taken.add(d)
    assert set(rows(stages[4])) == taken
    assert all(rows(stages[3])[d] == r for d, r in rows(stages[4]).items())


def test_encoding(spark, stages):
    with open(tokenizer_file("piece_bpe_32k.model"), "rb") as f:
        model = sentencepiece_viterbi.Model(f.read())
    before = rows(stages[4])
    after = rows(stages[5])
    assert set(after) == set(before)
    for d, r in after.items():
        assert model.decode(r["ids"]) == before[d]["text"] and r["decoded_sha256"] == hashlib.sha256(before[d]["text"].encode()).hexdigest()


def test_run(spark, small, stages):
    assert rows(p.run(spark, small)) == rows(stages[5])
