"""The operators' queries against brute force over whole tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash

from seqgraph.llm import queries as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="session")
def documents(small):
    return duckdb.connect().execute(f"SELECT doc_id, text FROM '{small}/documents.parquet' ORDER BY doc_id").fetchall()


@pytest.fixture(scope="session")
def vectors(small):
    rows = duckdb.connect().execute(f"SELECT vec_id, embedding FROM '{small}/embeddings.parquet' ORDER BY vec_id").fetchall()
    return np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float32)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_op1(spark, small):
    rows = duckdb.connect().execute(f"SELECT conv_id, turn, role, coalesce(text, '') FROM '{small}/conversations.parquet' ORDER BY 1, 2").fetchall()
    odd = "\\### Assistant: </turn> ok"
    rows += [(-7, 0, "user", odd), (-7, 1, "assistant", odd)]
    convs = defaultdict(list)
    for conv, _, role, text in rows:
        convs[conv].append((role, text))
    got = {r["conv_id"]: r for r in q.op1_chat_format(spark, small).collect()}
    assert set(got) == set(convs)
    for conv, turns in convs.items():
        r, loss = got[conv], "".join(t for role, t in turns if role == "assistant")
        assert r["n_turns"] == len(turns)
        assert r["turns_sha256"] == sha("".join(f"{a}\n{b}\n" for a, b in turns))
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), sha(loss))


def test_op2(spark, small, documents):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(q.tokenizer_file("word_bpe_49k.json"))
    want, start = {}, 0
    for doc_id, text in documents:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        want[doc_id] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in q.op2_token_files(spark, small).collect()}
    assert got == want


def test_op3(spark, small, documents):
    words = {d: WORD.findall(t or "") for d, t in documents}
    seen = Counter(tuple(w[i : i + 35]) for w in words.values() for i in range(len(w) - 34))
    got = {r["doc_id"]: r for r in q.op3_substring_dedup(spark, small).collect()}
    for d, w in words.items():
        drop = [False] * len(w)
        for i in range(len(w) - 34):
            if seen[tuple(w[i : i + 35])] > 1:
                drop[i : i + 35] = [True] * 35
        kept = " ".join(x for x, y in zip(w, drop) if not y)
        assert (got[d]["n_words"], got[d]["n_removed"], got[d]["kept_sha256"]) == (len(w), sum(drop), sha(kept)), d


def test_op4(spark, small, vectors):
    ids, x = vectors
    x = x.astype(np.float64)
    want = {int(ids[i]): [int(ids[j]) for j in np.lexsort((ids, -(x @ x[i]))) if j != i][:20] for i in np.flatnonzero(ids % 20 == 0)}
    got, place = defaultdict(list), {int(v): k for k, v in enumerate(ids)}
    for r in sorted(q.op4_cross_polytope(spark, small).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append(r["vec_id"])
        assert r["rank"] == len(got[r["query_id"]])
        assert abs(r["score"] - float(x[place[r["vec_id"]]] @ x[place[r["query_id"]]])) < 1e-12
    recall = np.mean([len(set(got[k]) & set(v)) / len(v) for k, v in want.items()])
    assert set(got) == set(want) and recall >= 0.9, recall


def test_op5(spark):
    small = "/root/testdata/sf0.01"  # enough labels to learn from
    documents = duckdb.connect().execute(f"SELECT doc_id, text FROM '{small}/documents.parquet'").fetchall()
    labels = dict(duckdb.connect().execute(f"SELECT doc_id, quality FROM '{small}/labels.parquet'").fetchall())
    got = {r["doc_id"]: r for r in q.op5_compression_quality(spark, small).collect()}
    assert set(got) == {d for d, _ in documents}
    for d, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    # the scores again, from the dictionaries and the curve
    import zstandard

    from seqgraph.llm import compression_quality as cq

    docs = q.table(spark, small, "documents").select("doc_id", "text")
    model = cq.fit(docs, q.table(spark, small, "labels"))
    sizes = []
    for raw in (model["good"], model["bad"]):
        c = zstandard.ZstdCompressor(level=cq.LEVEL, dict_data=zstandard.ZstdCompressionDict(raw), write_checksum=False, write_content_size=False, write_dict_id=False)
        sizes.append({d: sum(len(c.compress(t.encode()[i : i + cq.BLOCK])) for i in range(0, len((t or "").encode()), cq.BLOCK)) for d, t in documents if t})
    for d, t in documents:
        x = (sizes[1][d] - sizes[0][d]) / len(t.encode()) if t else 0.0
        assert got[d]["score"] == pytest.approx(1 / (1 + np.exp(-(model["intercept"] + model["slope"] * x))), abs=1e-9)
    right = [r["predicted"] == labels[d] for d, r in got.items() if r["held_out"] and d in labels]
    assert np.mean(right) >= 0.9


def test_op6(spark, small, vectors):
    ids, x = vectors
    x = np.floor(256 * x.astype(np.float64)).astype(np.int64)
    want = {}
    for i in np.flatnonzero(ids % 50 == 0):
        s = x @ x[i]
        order = [j for j in np.lexsort((ids, -s)) if j != i][:5]
        want[int(ids[i])] = [(int(ids[j]), int(s[j])) for j in order]
    got = defaultdict(list)
    for r in sorted(q.op6_va_file(spark, small).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert got == want


def simhash(text):
    words = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = WORD.findall(words)
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_op7(spark, small, documents):
    prints = {d: simhash(t) for d, t in documents}
    root = {d: d for d in prints}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    items = sorted(prints.items())
    for i, (a, x) in enumerate(items):
        for b, y in items[i + 1 :]:
            if (x ^ y).bit_count() <= 3:
                ra, rb = sorted((find(a), find(b)))
                root[rb] = ra
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in q.op7_simhash_dedup(spark, small).collect()}
    assert got == {d: (f"{x:016x}", find(d)) for d, x in items}


def test_op8(spark, small, documents):
    """Whole-query ids against a plain Viterbi over all pieces, and the exact round trip."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=q.tokenizer_file("piece_bpe_32k.model"))
    byte, score, ident = {}, {}, {}
    for i in range(sp.get_piece_size()):
        if sp.is_byte(i):
            byte[int(sp.id_to_piece(i)[3:5], 16)] = i
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            score[sp.id_to_piece(i)], ident[sp.id_to_piece(i)] = sp.get_score(i), i
    unknown, longest = min(score.values()) - 10, max(map(len, score))

    def plain(text):
        text, n = "\u2581" + text.replace(" ", "\u2581"), len(text) + 1
        best, back = [0.0] + [float("-inf")] * n, [0] * (n + 1)
        for e in range(1, n + 1):
            for s in range(max(0, e - longest), e):
                value = best[s] + score.get(text[s:e], unknown if e - s == 1 else float("-inf"))
                if value > best[e]:
                    best[e], back[e] = value, s
        out, e = [], n
        while e:
            piece = text[back[e] : e]
            out += [ident[piece]] if piece in ident else [byte[b] for b in reversed(piece.encode())]
            e = back[e]
        return out[::-1]

    got, seen = {r["doc_id"]: r for r in q.op8_sentencepiece(spark, small).collect()}, 0
    for d, text in documents:
        assert got[d]["decoded_sha256"] == sha(text) and got[d]["n_tokens"] == len(got[d]["ids"])
        if text and "\u2581" not in text and seen < 1_000_000:
            seen += len(text)
            assert list(got[d]["ids"]) == plain(text), d


def test_op9(spark, small, documents):
    """All documents against counts in dictionaries, each scored without its own counts."""
    from math import log2

    from seqgraph.llm.cross_entropy import A, B

    good = {d for d, v in duckdb.connect().execute(f"SELECT doc_id, quality FROM '{small}/labels.parquet'").fetchall() if v == 1}
    tokens = {d: ["<s>", *WORD.findall(t or ""), "</s>"] for d, t in documents}
    vocabulary = len({w for t in tokens.values() for w in t[1:]})
    words, pairs = {flag: Counter() for flag in (False, True)}, {flag: Counter() for flag in (False, True)}
    for d, t in tokens.items():
        words[d in good].update(t)
        pairs[d in good].update(zip(t, t[1:]))
    got = {r["doc_id"]: r for r in q.op9_cross_entropy(spark, small).collect()}
    assert set(got) == set(tokens)
    for d, t in tokens.items():
        own_words, own_pairs, loss = Counter(t), Counter(zip(t, t[1:])), []
        for flag in (True, False):
            mine = int((d in good) == flag)
            n = sum(words[flag].values()) - words[flag]["<s>"] - mine * (len(t) - 1)
            c = lambda found, own, key: found[key] - mine * own[key]  # noqa: B023, E731
            low = {w: (c(words[flag], own_words, w) + A / vocabulary) / (n + A) for w in own_words}
            loss.append(sum(-log2((c(pairs[flag], own_pairs, (h, w)) + B * low[w]) / (c(words[flag], own_words, h) + B)) for h, w in zip(t, t[1:])) / (len(t) - 1))
        r = got[d]
        assert r["n_tokens"] == len(t) - 1 and (r["loss_target"], r["loss_background"]) == (pytest.approx(loss[0]), pytest.approx(loss[1]))
        assert r["score"] == pytest.approx(loss[0] - loss[1], abs=1e-9)
