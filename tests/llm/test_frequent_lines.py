from collections import defaultdict

import duckdb
import numpy as np
from pyspark.sql import functions as F

from linewright.llm import queries
from linewright.llm.frequent_lines import clean_documents, line_verdicts
from llm_support import SF_DIR, by_id


def test_a_line_of_many_documents_goes_and_the_rest_stays(docs_of, prose):
    notice = "See our  TERMS of use today"
    rows = [(i, f"{prose(i, 30)}\n{notice}\n{prose(100 + i, 30)}", "h") for i in range(20)]
    rows += [(50 + i, f"{prose(200 + i, 12)}\n{notice}", "other") for i in range(5)]
    got = by_id(line_verdicts(docs_of(rows)))
    assert all(got[i]["n_left"] == 60 and got[i]["kept"] for i in range(20))
    # Another host has its own count.
    assert all(got[50 + i]["n_left"] == 18 for i in range(5))
    cleaned = by_id(clean_documents(docs_of(rows)))
    assert cleaned[0]["text"] == rows[0][1].replace("\n" + notice, "")
    assert cleaned[50]["text"] == rows[20][1]


def test_depleted_documents_are_rejected(docs_of, prose):
    notice = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(i, f"{prose(i, 30)}\n{notice}") for i in range(20)] + [(99, f"{notice}\nshort end")]
    got = by_id(line_verdicts(docs_of(rows)))
    assert not got[99]["kept"] and not got[99]["base_failed"] and got[99]["n_left"] == 2


def test_copies_are_one_document(docs_of, prose):
    text = "\n".join(prose(i, 12) for i in range(8))
    near = [(100 + i, text.replace("\n", f" tail{i}\n", 1)) for i in range(60)]
    got = by_id(line_verdicts(docs_of([(i, text) for i in range(60)] + near)))
    assert all(r["kept"] for r in got.values())


def test_repeated_windows_against_brute_force(docs_of):
    texts = ["a b c d e " * 3, "a b c d e f g a b c d e", "q w e r t y u i o p", "z " * 12, "a b c"]
    rows = list(enumerate(texts))
    got = by_id(line_verdicts(docs_of(rows)))
    for i, text in rows:
        words = text.split()
        at = defaultdict(list)
        for k in range(len(words) - 4):
            at[tuple(words[k : k + 5])].append(k)
        covered = {p for v in at.values() if len(v) > 1 for k in v for p in range(k, k + 5)}
        assert got[i]["n_repeat_words"] == len(covered), text


def test_long_text_of_repeats_is_linear(docs_of):
    got = line_verdicts(docs_of([(1, "a b c d e f g " * 20_000)])).collect()
    assert got[0]["n_repeat_words"] == 140_000


def test_awkward_rows(docs_of, awkward):
    docs = docs_of(awkward).withColumns({"digest": F.lit(1), "row": F.lit("r"), "kept": F.lit(0)})
    got = line_verdicts(docs).collect()
    assert len(got) == len(awkward)
    empty = [r for r in got if r["doc_id"] in (1, 2, 3)]
    assert all(r["n_words"] == 0 and r["base_failed"] and not r["kept"] for r in empty)
    assert set(clean_documents(docs).columns) == set(docs.columns)
    assert line_verdicts(docs_of([])).collect() == []


def test_null_hosts_count_together(docs_of, prose):
    rows = [(i, f"{prose(i, 30)}\nthe same line here", None) for i in range(15)]
    assert all(r["n_left"] == 30 for r in line_verdicts(docs_of(rows)).collect())


def test_limits_of_sizes_do_not_change_results(docs_of, prose, monkeypatch):
    rows = [(i, f"{prose(i, 30)}\nthe same line here") for i in range(15)]
    monkeypatch.setattr("linewright.llm.frequent_lines.MAX_BROADCAST_LINES", 0)
    assert all(r["n_left"] == 30 for r in line_verdicts(docs_of(rows)).collect())


def test_plan_has_no_python(docs_of):
    plan = line_verdicts(docs_of([(1, "a")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_against_sql(spark):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF_DIR}/documents.parquet'")
    expected = {r[0]: r for r in duck.execute(queries.OP9_SQL).fetchall()}
    got = queries.op9_frequent_lines(spark, SF_DIR).collect()
    assert {r["doc_id"]: tuple(r) for r in got} == expected


def test_copies_do_not_protect_a_line(docs_of, prose):
    """A footer of 400 different pages goes, however often one of them is copied."""
    footer = "all rights are kept by the owner of this page"
    pages = [(i, f"{prose(i, 40)}\n{footer}") for i in range(400)]
    copies = [(1000 + i, pages[0][1]) for i in range(401)]
    got = by_id(line_verdicts(docs_of(pages + copies)))
    assert all(r["n_left"] == 40 and r["kept"] for r in got.values())


def test_pages_of_one_template(docs_of, prose):
    """300 pages a host of 20 shared and 5 own lines: every host loses the shared ones."""
    rows = []
    for host in range(4):
        shared = "\n".join(prose(100_000 + host * 100 + i, 9, 5000) for i in range(20))
        for page in range(300):
            own = "\n".join(prose(host * 5000 + page * 5 + i, 9, 5000) for i in range(5))
            rows.append((host * 1000 + page, f"{shared}\n{own}", f"h{host}"))
    got = by_id(line_verdicts(docs_of(rows)))
    assert {r["n_left"] for r in got.values()} == {45}
    # What is left is a fifth, so the pages are depleted.
    assert not any(r["kept"] for r in got.values())


def test_a_large_group_of_near_copies_stays(docs_of, prose):
    lines = [prose(i, 25, 5000) for i in range(8)]
    rows = []
    for i in range(700):
        words = lines[i % 8].split()
        words[i % 25] = f"changed{i}"
        rows.append((i, "\n".join([*lines[: i % 8], " ".join(words), *lines[i % 8 + 1 :]])))
    got = by_id(line_verdicts(docs_of(rows)))
    assert all(r["kept"] and r["n_left"] == r["n_words"] for r in got.values())


def test_pages_of_shared_lines_alone_are_rejected(docs_of, prose):
    pool = [prose(i, 12, 5000) for i in range(40)]
    draw = np.random.default_rng(3)
    rows = [(i, "\n".join(pool[k] for k in draw.choice(40, 3, replace=False))) for i in range(600)]
    got = by_id(line_verdicts(docs_of(rows)))
    assert not any(r["kept"] for r in got.values())
    assert {r["n_left"] for r in got.values()} == {0}
