"""The queries over whole tables, beside SQL or plain Python."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from math import log10

import numpy as np
import public_tokenizers
import pytest
from compare import connect, differences
from tokenizers import Tokenizer

import corpus_pipeline
from quillprint.llm.oracle import ORACLE
from quillprint.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows(spark, sf_dir, name):
    return QUERIES[name](spark, sf_dir).collect()


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}


def fold(doc_id: int, n: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % n


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, sf_dir, name):
    problem, n = differences(spark, connect(sf_dir), QUERIES[name], ORACLE[name], sf_dir)
    assert not problem
    assert n > 0


def test_quality_rules(spark, sf_dir, texts):
    for r in rows(spark, sf_dir, "op2_quality_rules"):
        text = texts[r.doc_id]
        words = WORD.findall(text)
        grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        often = Counter(grams)
        repeated = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        failed = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
        assert (r.n_words, r.word_chars, r.n_symbols) == (
            len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"),
        )
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), len(repeated))
        assert r.base_failed == failed
        assert r.kept == (not failed and r.ratio >= -0.06)


def test_packing(spark, sf_dir, texts):
    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = rows(spark, sf_dir, "op4_best_fit_packing")
    total = 0
    for doc, text in texts.items():
        ids = np.array([*model.encode(text, add_special_tokens=False).ids, 0], "<u4")
        total += len(ids)
        own = sorted((r for r in got if r.doc_id == doc), key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own)))
        at = 0
        for r in own:
            assert r.start == at
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            assert r.length == 2048 or r.piece == 0
            at += r.length
        assert at == len(ids)
    sequences: dict[int, list] = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= 1.05 * -(-total // 2048) + 2


def test_pieces_come_back(spark, sf_dir):
    got = rows(spark, sf_dir, "op5_sentencepiece")
    assert got
    assert all(r.round_trip for r in got)


def passes_luhn(digits):
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(x - 9 * (x > 9) for x in doubled) % 10 == 0


BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and passes_luhn(d)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
}


def base_spans(text):
    return [
        (kind, m.start(), m.end()) for kind, (pattern, valid) in BASE.items() for m in re.finditer(pattern, text) if valid(m.group())
    ]


def test_pii(spark, sf_dir, texts):
    for r in rows(spark, sf_dir, "op8_pii"):
        want = base_spans(texts[r.doc_id])
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, _, _ in want) for x in BASE]
        assert r.spans.startswith(joined)


def lowered_words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))


def test_lm_scores(spark, sf_dir, texts):
    trained = {d: t for d, t in texts.items() if fold(d, 10)}
    count = Counter(w for t in trained.values() for w in [*lowered_words(t), None])
    n, v = sum(count.values()), len(count)
    pairs: Counter = Counter()
    triples: Counter = Counter()
    for t in trained.values():
        own = [*lowered_words(t), None]
        pairs.update(zip(own, own[1:], strict=False))
        triples.update(zip(own, own[1:], own[2:], strict=False))
    for r in rows(spark, sf_dir, "op9_lm_scoring"):
        own = [*lowered_words(texts[r.doc_id]), None]
        single = [(count[w] + 0.1) / (n + 0.1 * (v + 1)) for w in own]
        score = 0.0
        for i, p in enumerate(single):
            if i > 0:
                p = (pairs[tuple(own[i - 1 : i + 1])] + 1000 * p) / (count[own[i - 1]] + 1000)
            if i > 1:
                p = (triples[tuple(own[i - 2 : i + 1])] + 3 * p) / (pairs[tuple(own[i - 2 : i])] + 3)
            score += log10(p)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(w in count for w in own), n)
        assert r.held_out == (fold(r.doc_id, 10) == 0)
        assert r.base_score == pytest.approx(sum(map(log10, single)))
        assert r.score == pytest.approx(score)


@pytest.mark.parametrize(
    ("name", "label", "folds", "held", "cut", "least"),
    [("op6_toxicity", "toxic", 5, 0, 0.5, 0.9), ("op10_quality_classifier", "quality", 4, 2, 0.7, 0.95)],
)
def test_held_out_accuracy(spark, name, label, folds, held, cut, least):
    """Balanced over the two labels; on a table with enough labels for both."""
    sf_dir = "/root/testdata/sf0.1"
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    hits = {0: [], 1: []}
    got = rows(spark, sf_dir, name)
    for r in got:
        assert r.held_out == (fold(r.doc_id, folds) == held)
        assert 0 <= r.score <= 1
        assert r.predicted == (r.score >= cut)
        if r.held_out and labels.get(r.doc_id) is not None:
            hits[labels[r.doc_id]].append(r.predicted == labels[r.doc_id])
    assert len(got) == 10_000
    assert np.mean([np.mean(h) for h in hits.values() if h]) >= least


def test_pipeline(spark, sf_dir, texts):
    """Each stage on its own input: what it keeps, and that the pieces cover what was kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, dict(texts)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, sf_dir), name)
        assert docs.columns == columns
        now = {r.doc_id: r.text for r in docs.collect()}
        assert set(now) <= set(kept)
        if name == "near_duplicates":
            sets = {d: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for d, t in kept.items() for w in [lowered_words(t)]}
            root = {d: d for d in sets}

            def find(d, root=root):
                while root[d] != d:
                    d = root[d]
                return d

            ids = sorted(sets)
            for i, a in enumerate(ids):
                for b in ids[i + 1 :]:
                    if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and find(a) != find(b):
                        root[max(find(a), find(b))] = min(find(a), find(b))
            assert set(now) == {d for d in ids if find(d) == d}
        elif name == "personal_data":
            assert set(now) == set(kept)
            assert not any(k in ("email", "card") for t in now.values() for k, _, _ in base_spans(t))
        kept = now
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {r.doc_id for r in pieces} == set(kept)
