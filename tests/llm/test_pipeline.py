import importlib.util
import os
import re
from collections import Counter

import corpus_pipeline
import pytest
from llm_support import SF_DIR
from pyspark.sql import functions as F
from test_private_data import brute as brute_spans
from test_repeats import brute as brute_kept
from test_simhash_trees import brute_labels, brute_print

from linewright.llm import queries
from linewright.llm.frequent_lines import line_verdicts


@pytest.fixture(scope="module")
def stages(spark):
    """The documents before the first stage and after each."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF_DIR).cache()
        out.append(docs)
    return out


def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


def test_stages_keep_the_columns_and_their_lengths(stages):
    assert len(corpus_pipeline.STAGES) in (4, 5)
    for docs in stages[1:-1]:
        assert docs.dtypes == stages[0].dtypes
        assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())


def test_quality_rules(stages):
    kept = {r["doc_id"] for r in line_verdicts(stages[0]).filter("kept").collect()}
    before, after = texts(stages[0]), texts(stages[1])
    assert set(after) == kept
    for doc_id, text in after.items():
        rest = iter(before[doc_id].split("\n"))
        assert all(line in rest for line in text.split("\n")) or text == ""


def test_one_document_of_each_near_group(stages):
    before, after = texts(stages[1]), texts(stages[2])
    ids = sorted(before)
    labels = brute_labels([brute_print(before[i]) for i in ids], ids)
    assert set(after) == set(labels)
    assert all(after[i] == before[i] for i in after)


def test_repeated_passages(stages):
    before, after = texts(stages[2]), texts(stages[3])
    rows = sorted(before.items())
    expected = {i: k for (i, _), k in zip(rows, brute_kept(rows, 20), strict=True)}
    assert {i: re.findall("[^\x20\x09-\x0d]+", t) for i, t in after.items()} == expected


def test_no_pattern_is_left(stages):
    before, after = texts(stages[3]), texts(stages[4])
    assert set(before) == set(after)
    assert sum(len(brute_spans(t)) for t in before.values()) > 0
    assert sum(len(brute_spans(t)) for t in after.values()) == 0
    assert all(after[i] == t for i, t in before.items() if not re.search("[0-9@]", t))


def test_run_packs_every_kept_document(spark, stages):
    rows = corpus_pipeline.run(spark, SF_DIR).collect()
    assert {r["doc_id"] for r in rows} == set(texts(stages[4]))
    by_doc, by_sequence = Counter(), Counter()
    for r in rows:
        by_doc[r["doc_id"]] += r["length"]
        by_sequence[r["sequence_id"]] += r["length"]
    assert all(by_doc[r["doc_id"]] == r["doc_tokens"] for r in rows)
    assert max(by_sequence.values()) <= corpus_pipeline.SEQUENCE_TOKENS
    assert Counter(map(tuple, rows)) == Counter(map(tuple, stages[5].collect()))


def test_all_queries_are_registered():
    root = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    spec = importlib.util.spec_from_file_location("entry_of_pipeline", f"{root}/__spark_entry__.py")
    entry = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(entry)
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())
    assert {int(re.match(r"op(\d+)_", q)[1]) for q in queries.QUERIES} == set(range(1, 14))
    assert set(queries.ORACLES) <= set(entry.oracle_sql())


def test_stages_take_awkward_rows(spark, awkward, docs_of):
    """Each stage over NULLs, empty and long texts, repeated rows and clashing names."""
    extra = ["row", "key", "print", "_id", "part", "line", "spans", "band"]
    docs = docs_of([*awkward, (20, awkward[3][1]), (21, None, None)])
    for i, name in enumerate(extra):
        docs = docs.withColumn(name, F.lit(i))
    before = [tuple(r) for r in docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, SF_DIR)
        rows = made.collect()
        if name == "packing":
            assert {r["doc_id"] for r in rows} == {r[0] for r in before}
            continue
        assert made.columns == docs.columns
        ids = [r["doc_id"] for r in rows]
        if name == "quality_rules":
            assert {None, 5, 20} <= set(ids) and not {1, 2, 3, 6, 21} & set(ids)
        elif name == "simhash_near_dedup":
            assert sorted(ids) == [1, 4, 5, 6, 7, 8]
        elif name == "substring_dedup":
            texts = [(r["doc_id"], r["text"]) for r in rows]
            assert len(rows) == len(before) and (1, None) in texts and (2, "") in texts
            assert (None, awkward[5][1]) in texts and (5, awkward[6][1]) in texts
            # A repeated row is the same document; the later copy of its text loses all words.
            assert [t.split() for i, t in texts if i == 20] == [[]]
            assert [t for i, t in texts if i == 4] == [awkward[3][1]] * 2
        else:
            assert len(rows) == len(before) and (21, None) in [(r["doc_id"], r["text"]) for r in rows]


def test_stages_take_an_empty_table(spark, docs_of):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs_of([]), SF_DIR).collect() == []
