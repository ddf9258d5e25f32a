"""The pipeline, stage by stage, against brute force: which rows stay, and their texts."""

import itertools
import random
from collections import Counter

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
pytest.importorskip("public_tokenizers")

from graphband.llm import quality_rules  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    rng = random.Random(21)
    vocabulary = ["".join(rng.choice("aeioubcdlmnrst") for _ in range(rng.randint(2, 8))) for _ in range(600)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, base = text(50), [text(rng.randint(30, 160)) for _ in range(30)]
    texts = [*base, *(b.upper() if i % 9 == 0 else b for i, b in enumerate(base[:10]))]
    for b in base[10:16]:
        w = b.split()
        w[3] = "other"
        texts.append(" ".join(w))
    texts += [f"{text(15)} {passage}\n{text(12)}" for _ in range(4)]
    texts += [None, "", "few words", " ".join(f"{w}###" for w in text(40).split()), "again " * 60]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    rows.append(rows[20])  # a row twice
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    return folder


def rows(df):
    return sorted(((r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in df.collect()), key=str)


def brute(name, docs):
    words = lambda t: (t or "").encode().split()
    if name == "exact dedup":
        best = {}
        for r in docs:
            key = (r[1] or "").encode().lower()
            best[key] = max(best.get(key, r[0]), r[0])
        return [r for r in docs if best[(r[1] or "").encode().lower()] == r[0]]
    if name == "near duplicates":
        sets = [frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if (w := [x.lower() for x in words(r[1])]) else frozenset() for r in docs]
        group = list(range(len(docs)))
        for (a, x), (b, y) in itertools.combinations(enumerate(sets), 2):
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                old, new = group[b], group[a]
                group = [new if g == old else g for g in group]
        least = {}
        for r, g in zip(docs, group, strict=True):
            least[g] = min(least.get(g, r[0]), r[0])
        return [r for r, g in zip(docs, group, strict=True) if least[g] == r[0]]
    seen = Counter(tuple(w[k : k + 35]) for r in docs for w in [words(r[1])] for k in range(len(w) - 34))
    out = []
    for r in docs:
        w = words(r[1])
        gone = {k + i for k in range(len(w) - 34) if seen[tuple(w[k : k + 35])] > 1 for i in range(35)}
        t = b" ".join(x for i, x in enumerate(w) if i not in gone).decode() if gone else r[1]
        out.append((r[0], t, r[2], r[3], len(t) if t is not None else None))
    return out


def test_stages(spark, table, tmp_path):
    docs = spark.read.parquet(f"{table}/documents.parquet")
    kept = {r["doc_id"] for r in quality_rules.judge(docs).where("kept").collect()}
    assert not kept & {r[0] for r in rows(docs) if len((r[1] or "").split()) < 10} and len(kept) > 40
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        before = rows(docs)
        want = [r for r in before if r[0] in kept] if i == 0 else brute(name, before)
        out = stage(spark, docs, table)
        assert out.columns == docs.columns
        assert rows(out) == sorted(want, key=str), name
        assert len(want) < len(before) or name == "substring dedup" and want != before
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
    last = corpus_pipeline.STAGES[-1][1](spark, docs, table)
    assert sorted({r["doc_id"] for r in last.select("doc_id").collect()}) == sorted({r[0] for r in rows(docs)})
    whole = last.groupBy("doc_id", "doc_tokens").sum("length").collect()
    copies = Counter(r[0] for r in rows(docs))
    assert all(r["sum(length)"] == copies[r["doc_id"]] * r["doc_tokens"] for r in whole)
    run = corpus_pipeline.run(spark, table)
    pieces = lambda df: sorted(tuple(r) for r in df.select("doc_id", "start", "doc_tokens").collect() if r["start"] == 0)
    assert pieces(run) == pieces(last)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
