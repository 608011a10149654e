
import pytest
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql import functions as F

from linewright.functions import register
from linewright.functions import tokens as T
from linewright.operators.fix import fix
from linewright.operators.lint import lint
from linewright.operators.tokens import token_budget, token_counts, token_rows
from linewright.streaming import lines as streams
from workloads.counting import byte_tokenizer, word_tokenizer


@pytest.fixture(scope="module")
def trained(spark, tmp_path_factory):
    """A small byte-level BPE tokenizer in a file."""
    from tokenizers import Tokenizer, decoders, models, pre_tokenizers, trainers

    tokenizer = Tokenizer(models.BPE())
    tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    tokenizer.decoder = decoders.ByteLevel()
    trainer = trainers.BpeTrainer(
        vocab_size=300, initial_alphabet=pre_tokenizers.ByteLevel.alphabet(), show_progress=False
    )
    tokenizer.train_from_iterator(["hello world, hello there", "the world is wide"] * 5, trainer)
    path = tmp_path_factory.mktemp("tok") / "small.json"
    tokenizer.save(str(path))
    return T.choose_tokenizer(spark, "anything", path=str(path)), tokenizer


def test_names():
    assert T.parse_backend("TK") == "tiktoken"
    assert T.parse_backend("Llama") == "huggingface"
    assert T.parse_backend("gpt-2") == "gpt2"
    assert T.parse_backend("nope") is None
    assert T.parse_encoding("GPT4") == "cl100k_base"
    assert T.parse_encoding("codex") == "p50k_base"
    assert T.parse_encoding("nope") is None


def test_bpe_counts_and_spans(spark, trained):
    chosen, local = trained
    assert chosen.name == "small"
    texts = ["hello world", "", "Hello, wörld! 😀 the", None]
    frame = spark.createDataFrame(list(enumerate(texts)), "row_id bigint, line string")
    counts = {r.row_id: r.tokens for r in token_counts(frame, chosen).collect()}
    assert counts == {i: len(local.encode(t).ids) if t else 0 for i, t in enumerate(texts)}
    ids = frame.select("row_id", T.token_ids(F.col("line"), chosen).alias("i")).collect()
    assert {r.row_id: r.i for r in ids}[2] == local.encode(texts[2]).ids
    rows = token_rows(frame.filter("row_id = 2"), chosen).orderBy("position").collect()
    raw = texts[2].encode()
    for row, (start, end) in zip(rows, local.encode(texts[2]).offsets):
        assert raw[row.byte_start : row.byte_end].decode() == texts[2][start:end]


def test_byte_tokens_and_segments(spark):
    chosen = byte_tokenizer(spark)
    frame = spark.createDataFrame([(0, "aé")], "row_id bigint, line string")
    details = frame.select(T.token_details(F.col("line"), chosen).alias("d")).first().d
    assert [(d.token_id, d.byte_start, d.byte_end) for d in details] == [(97, 0, 1), (195, 1, 2), (169, 2, 3)]
    pieces = frame.select(T.token_segments(F.col("line"), chosen).alias("p")).first().p
    assert [(p.is_token, p.text) for p in pieces] == [(True, "a"), (True, "é")]


def test_word_segments_and_budget(spark):
    chosen = word_tokenizer(spark)
    frame = spark.createDataFrame([("x", "hello,  world"), ("x", "a"), ("y", "b c")], "g string, t string")
    pieces = frame.select(T.token_segments(F.col("t"), chosen).alias("p")).first().p
    assert [(p.is_token, p.text) for p in pieces] == [
        (True, "hello"),
        (True, ","),
        (False, "  "),
        (True, "world"),
    ]
    budget = token_budget(frame, chosen, "t", ["g"]).orderBy("g").collect()
    assert [tuple(r) for r in budget] == [("x", 2, 4, 2.0, 3), ("y", 1, 2, 2.0, 2)]


def test_special_tokens(spark):
    chosen = T.tokenizer_from_ranks(
        spark, "special", {bytes([v]): v for v in range(256)}, r"[\s\S]", {"<|end|>": 256}
    )
    frame = spark.createDataFrame([("a<|end|>",)], "t string")
    assert frame.select(T.token_ids(F.col("t"), chosen)).first()[0] == [97, 256]


def test_sql_functions(spark):
    register.register_functions(spark, word_tokenizer(spark))
    row = spark.sql(
        "select count_tokens('a b, c') n, is_strict_json('[1] x') v, canonical_json('{\"b\":1,\"a\":2}') c, "
        "fix_line('{\"a\":\"x \"}').outcome o, hex(simhash64('abc')) = hex(fnv1a64('abc')) h"
    ).first()
    assert tuple(row) == (4, False, '{"a":2,"b":1}', "fixed", True)


def write_units(path, units):
    for number, rows in enumerate(units):
        (path / f"u{number}.jsonl").write_text("\n".join(rows) + "\n")


def test_stream_lines_and_progress(spark, tmp_path):
    write_units(tmp_path, [["{}", "bad"], ['{"a":"x "}'], ["{}", "{}"]])
    stream = streams.stream_lines(spark, str(tmp_path))
    query, table = streams.load_available(stream)
    assert table.count() == 5
    progress = streams.stream_progress(query).orderBy("batch").collect()
    assert sorted(p.rows for p in progress) == [1, 2, 2]
    assert streams.is_complete(query)
    assert streams.loaded_units(query) == 3


def test_operators_on_a_stream_match_batch(spark, tmp_path):
    source = tmp_path / "units"
    rows = [(i, f'{{"text":"<think>{i} "}}' if i % 2 else "nope") for i in range(40)]
    frame = spark.createDataFrame(rows, "row_id bigint, line string")
    frame.repartition(4).write.parquet(str(source))
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    for operator in (lambda f: lint(f, ["id"]), fix):
        got = streams.load_available(operator(stream))[1].collect()
        assert sorted(map(str, got)) == sorted(map(str, operator(frame).collect()))


def test_failed_unit_keeps_what_arrived(spark, tmp_path):
    source = tmp_path / "units"
    source.mkdir()
    schema = spark.range(1).schema
    import os
    import time

    spark.range(5).coalesce(1).write.parquet(str(tmp_path / "good"))
    good = next(p for p in (tmp_path / "good").iterdir() if p.suffix == ".parquet")
    (source / "a.parquet").write_bytes(good.read_bytes())
    (source / "b.parquet").write_bytes(b"not a parquet file at all")
    now = time.time()
    os.utime(source / "a.parquet", (now - 100, now - 100))
    stream = streams.stream_rows(spark, str(source), schema, "parquet")
    target = str(tmp_path / "out")
    query = (
        stream.writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", str(tmp_path / "ck"))
        .trigger(availableNow=True)
        .start()
    )
    with pytest.raises(Exception):
        query.awaitTermination()
    assert not streams.is_complete(query)
    assert spark.read.parquet(target).count() == 5




def test_progress_has_every_unit(spark, tmp_path):
    for i in range(110):
        (tmp_path / f"{i:03}.jsonl").write_text(f'{{"n": {i}}}\n')
    query, table = streams.load_available(streams.stream_lines(spark, str(tmp_path)))
    assert table.count() == 110 and streams.stream_progress(query).count() == 110


@pytest.mark.parametrize(
    "name, body", [("bad.csv", "a,b\nonly\n"), ("bad.csv", "a,b\n3,4,5\n"), ("bad.json", '{"a": "1"\n')]
)
def test_a_stream_refuses_what_a_batch_refuses(spark, tmp_path, name, body):
    (tmp_path / name).write_text(body)
    schema = StructType([StructField(c, StringType()) for c in "ab"])
    rows = streams.stream_rows(spark, str(tmp_path), schema, "csv" if "csv" in name else "jsonl")
    with pytest.raises(Exception):
        streams.load_available(rows)


def test_progress_of_a_query_the_user_starts(spark, tmp_path):
    source, record = tmp_path / "units", str(tmp_path / "record")
    source.mkdir()
    settings = dict(spark.conf.getAll)

    def run(first, last):
        for i in range(first, last):
            (source / f"{i:03}.jsonl").write_text("{}\n" * (1 + i % 3))
        query = (
            streams.stream_lines(spark, str(source))
            .writeStream.format("parquet")
            .option("path", str(tmp_path / "data"))
            .option("checkpointLocation", str(tmp_path / "checkpoint"))
            .trigger(availableNow=True)
            .start()
        )
        streams.follow_progress(query, record)
        return query

    one = run(0, 120)
    two = run(120, 200)
    assert one.id == two.id and one.runId != two.runId
    units = streams.stream_progress(two).orderBy("batch").collect()
    assert [u.batch for u in units] == list(range(200))
    assert sum(u.rows for u in units) == sum(1 + i % 3 for i in range(200))
    assert all(u.duration_ms >= 0 for u in units)
    assert dict(spark.conf.getAll) == settings
    assert streams.recorded_progress(spark, record).select("query").distinct().count() == 1


def test_progress_on_record_is_bounded_on_the_driver(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streams, "UNITS_A_FILE", 5)
    monkeypatch.setattr(streams, "LOOK_SECONDS", 0.05)
    for i in range(30):
        (tmp_path / f"{i:03}.jsonl").write_text("{}\n")
    sizes = []
    append = streams._append
    monkeypatch.setattr(streams, "_append", lambda s, p, rows: (sizes.append(len(rows)), append(s, p, rows)))
    query, _ = streams.load_available(streams.stream_lines(spark, str(tmp_path)))
    assert sum(sizes) == 30 and streams.stream_progress(query).count() == 30
