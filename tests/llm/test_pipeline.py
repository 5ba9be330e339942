"""The pipeline against a plain version of its stages, and the entry's guard."""

import subprocess
import sys
from collections import Counter
from pathlib import Path

from pyspark.sql import functions as F

import corpus_pipeline
from siltstone.llm import gumbel, mixing, pii, quality_rules, unigram


def shingles(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).translate({ord(c): " " for c in "\t\n\x0b\x0c\r"}).split(" ")
    words = [w for w in words if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_groups(texts, similarity=0.8):
    """The smallest id of each id's group: all pairs, similarity by its definition."""
    label = {i: i for i in texts}
    sets = {i: shingles(t) for i, t in texts.items()}
    links = [(a, b) for a in texts for b in texts if a < b and (not sets[a] and not sets[b] or len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]) - 1e-9 and sets[a] | sets[b])]
    while any(label[a] != label[b] for a, b in links):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return label


def test_run_equals_the_stages(spark, sf, corpus, labels):
    rows = corpus_pipeline.run(spark, sf).collect()
    found = {r.doc_id: r for r in corpus.collect()}
    texts = {i: r.text for i, r in found.items()}
    judged = quality_rules.judge(corpus).filter("kept or n_words between 1 and 49 and not 100 * n_repeat_words > 50 * n_words and p_good >= 0.5")
    kept = {r.doc_id for r in judged.collect()}
    label = brute_groups({i: texts[i] for i in kept})
    alone = {i for i in kept if label[i] == i}
    clean = {i: pii.redact(texts[i]) for i in alone}
    docs = spark.createDataFrame([(i, t, found[i].lang) for i, t in clean.items()], "doc_id bigint, text string, lang string")
    copies = {r.doc_id: r["count"] for r in mixing.drawn(docs, labels, corpus_pipeline.TARGETS).groupBy("doc_id").count().collect()}
    model = unigram.load()
    assert {r.doc_id for r in rows} == alone
    assert all(model.decode(r.ids) == clean[r.doc_id] for r in rows)
    assert Counter(r.doc_id for r in rows if r.sample == 0) == Counter(copies)
    # copies of a document are sampled anew
    drawn = {}
    for r in rows:
        drawn.setdefault(r.doc_id, set()).add(tuple(r.ids))
    several = [i for i, n in copies.items() if n > 1 and len(clean[i].split()) > 30]
    assert several and all(len(drawn[i]) > 2 for i in several)


def test_stages_take_odd_rows(spark, sf, docs):
    """Nulls in all columns, empty and long texts, ties, rows that repeat, clashing columns and an empty table through every stage."""
    for start in (docs, docs.limit(0), docs.withColumn("doc_id", F.lit(None).cast("bigint")).withColumn("text", F.when(F.rand(1) < 0.7, F.col("text")))):
        columns, now = start.columns, start
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, sf)
            assert now.columns == columns, name
        assert corpus_pipeline.encode(spark, now, sf).columns[0] == "doc_id"
        corpus_pipeline.encode(spark, now, sf).collect()


def test_copies_are_told_apart(spark):
    some = spark.createDataFrame([(7, "the cat and the dog went home " * 9)] * 3 + [(8, "x")], "doc_id bigint, text string").coalesce(1)
    found = [r for r in gumbel.sample(some, number_copies=True).collect() if r.sample == 0]
    plain = [r for r in gumbel.sample(some).collect() if r.sample == 0]
    assert found[0] == plain[0] == plain[1] and found[3] == plain[3]
    assert len({tuple(r.ids) for r in found[:3]}) == 3


def test_stages_written_and_read(spark, sf, tmp_path):
    docs = corpus_pipeline.read(spark, sf, "documents")
    columns = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns, name
    assert docs.count() > 0


def test_entry_without_the_subpackage(tmp_path):
    repo = Path(__file__).resolve().parents[2]
    for name in ("siltstone", "__spark_entry__.py"):
        (tmp_path / name).symlink_to(repo / name) if name.endswith(".py") else None
    (tmp_path / "siltstone").mkdir()
    for p in (repo / "siltstone").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (tmp_path / "siltstone" / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'count_star' in q and 'pipeline' not in q and not any(k.startswith('op') and k[2].isdigit() for k in q); assert set(e.oracle_sql()) <= set(q)"
    (tmp_path / "__spark_entry__.py").unlink()
    (tmp_path / "__spark_entry__.py").write_text((repo / "__spark_entry__.py").read_text())
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
