"""The jobs: registered queries against SQL, growing input, reruns, command lines."""

import json
import os
import shutil
import subprocess
import sys
from collections import Counter
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobs import attribute_volumes, knowledge_index, queries
from quarry.operators import index, retrieval
from quarry.sources import views

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[1]
TABLES = "documents embeddings".split()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(queries.SQL[name])
    cols = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(cols)
    assert Counter(map(tuple, got.select(*cols).collect())) == Counter(want.fetchall())


def index_conf(tmp_path):
    return {"documents": f"{tmp_path}/docs", "output": f"{tmp_path}/index", "checkpoint": f"{tmp_path}/mark", "id": "doc_id", "text": "text", "files_per_batch": 2}


def brute_index(spark, rows):
    """(id, term, n, n_tokens, df) of the last text of every id."""
    toks = {i: t for i, t in rows if i is not None}
    cut = {r["i"]: r["t"] or [] for r in spark.createDataFrame(list(toks.items()), "i long, x string").select("i", retrieval.tokens(F.col("x")).alias("t")).collect()}
    df = Counter(t for ts in cut.values() for t in set(ts))
    return sorted((i, t, n, len(ts), df[t]) for i, ts in cut.items() for t, n in Counter(ts).items())


def add_file(spark, conf, rows):
    spark.createDataFrame(rows, "doc_id long, text string, extra string").coalesce(1).write.mode("append").parquet(conf["documents"])


def test_index_takes_only_what_is_new(spark, tmp_path):
    conf = index_conf(tmp_path)
    first = [(1, "Fault zone, fault throw"), (2, "well log 12.5"), (3, None), (4, "")]
    add_file(spark, conf, [(*r, "x") for r in first])
    done = knowledge_index.run(spark, conf)
    assert (done["rows"], done["batches"], done["documents"]) == (4, 1, 4)
    assert sorted(map(tuple, knowledge_index.contents(spark, conf).collect())) == brute_index(spark, first)
    # nothing new: nothing is read, nothing changes
    assert knowledge_index.run(spark, conf)["rows"] == 0
    # a second version of 1, a new 5, a null id, and one id twice in a batch
    second = [(1, "horizon and channel"), (5, "fault log log"), (None, "no id"), (6, "alpha"), (6, "beta")]
    add_file(spark, conf, [(*r, "x") for r in second])
    done = knowledge_index.run(spark, conf)
    assert (done["rows"], done["documents"]) == (5, 6)
    assert sorted(map(tuple, knowledge_index.contents(spark, conf).collect())) == brute_index(spark, first + second)
    # and a third version of 1 that has no text
    add_file(spark, conf, [(1, None, "x")])
    knowledge_index.run(spark, conf)
    assert sorted(map(tuple, knowledge_index.contents(spark, conf).collect())) == brute_index(spark, first + second + [(1, None)])


def test_a_batch_taken_again_replaces_itself(spark, tmp_path):
    path = f"{tmp_path}/index"
    docs = [spark.createDataFrame(rows, "doc_id long, text string") for rows in ([(1, "one two two"), (2, "two three")], [(2, "four"), (3, "two")])]
    kind = docs[0].schema["doc_id"].dataType
    index.add_batch(docs[0], path, 0)
    index.add_batch(docs[1], path, 1)
    state = lambda: (sorted(map(tuple, index.term_counts(spark, path, kind).drop("bucket").collect())), index.document_count(spark, path, kind).first()["N"], sorted(map(tuple, index.live_postings(spark, path, kind).drop("bucket").collect())))
    before = state()
    assert before[:2] == ([("four", 1, 1), ("one", 1, 1), ("two", 2, 3)], 3)
    index.add_batch(docs[1], path, 1)
    assert state() == before


def test_search_reads_the_index_alone(spark, tmp_path):
    docs = views.table(spark, SF, "documents").select("doc_id", "text")
    path, kind = f"{tmp_path}/index", docs.schema["doc_id"].dataType
    parts = docs.randomSplit([1.0, 1.0, 1.0], 7)
    for k, d in enumerate(parts):
        index.add_batch(d, path, k)
    asked = spark.createDataFrame([(1, "thing ing the heation"), (2, "license version software"), (3, "zzzz")], "query_id int, query string")
    want = {(r["query_id"], r["doc_id"]): r["score"] for r in retrieval.tfidf_scores(docs, asked, "doc_id", "text").collect()}
    found = index.search(asked, path, kind)
    got = {(r["query_id"], r["id"]): r["score"] for r in found.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert "bucket" in found._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1][:200]


def test_an_empty_folder_of_documents(spark, tmp_path):
    conf = index_conf(tmp_path)
    add_file(spark, conf, [])
    assert knowledge_index.run(spark, conf)["documents"] == 0
    assert knowledge_index.contents(spark, conf).count() == 0


def volume_conf(tmp_path, tables=SF, **more):
    return {"tables": tables, "output": f"{tmp_path}/out", **more}


def test_volumes_again_and_for_some_images(spark, tmp_path):
    conf = volume_conf(tmp_path)
    done = attribute_volumes.run(spark, conf)
    cells = lambda: sorted(map(tuple, attribute_volumes.volumes(spark, conf).collect()))
    before = cells()
    assert done["found"] == done["rejected"] + done["suppressed"] + done["kept"] == views.detections(spark, SF).count()
    assert len(before) == done["cells"] > 0
    assert attribute_volumes.run(spark, conf) == done and cells() == before
    some = sorted({c[1] for c in before})[:2]
    assert attribute_volumes.run(spark, conf | {"images": some})["found"] < done["found"]
    assert cells() == before  # other images are left as they are
    report = spark.read.json(f"{conf['output']}/report")
    assert report.count() == views.detections(spark, SF).select("image").distinct().count()


def test_volumes_follow_their_input(spark, tmp_path):
    """A second run over changed tables replaces cells, also those of a class that has lost all detections."""
    tables = f"{tmp_path}/tables"
    os.makedirs(tables)
    full = spark.read.parquet(f"{SF}/embeddings.parquet")
    image = full.agg(F.min("label")).first()[0]
    full.write.parquet(f"{tables}/embeddings.parquet")
    conf = volume_conf(tmp_path, tables)
    attribute_volumes.run(spark, conf)
    shutil.rmtree(f"{tables}/embeddings.parquet")
    # in one image only class 0 is left, and 3 of its detections, which verdicts reject or not as before
    less = full.where((F.col("label") != image) | (F.col("vec_id") % 4 == 0))
    less.write.parquet(f"{tables}/embeddings.parquet")
    attribute_volumes.run(spark, conf)
    fresh = volume_conf(f"{tmp_path}/fresh", tables)
    attribute_volumes.run(spark, fresh)
    cells = lambda c: sorted(map(tuple, attribute_volumes.volumes(spark, c).collect()))
    assert cells(conf) == cells(fresh) and cells(fresh)


@pytest.mark.parametrize("script", ["knowledge_index", "attribute_volumes"])
def test_command_lines(tmp_path, script):
    conf = json.loads((ROOT / "jobs" / f"{script}.json").read_text())
    conf |= {k: f"{tmp_path}/{k}" for k in ("output", "checkpoint") if k in conf}
    conf |= {"documents": f"{SF}/documents.parquet"} if "documents" in conf else {"tables": SF}
    (tmp_path / "conf.json").write_text(json.dumps(conf))
    done = subprocess.run([sys.executable, str(ROOT / "jobs" / f"{script}.py"), "--config", str(tmp_path / "conf.json")], capture_output=True, text=True, timeout=300, cwd=tmp_path)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "read " in done.stderr and "holds" in done.stderr
    assert any(Path(conf["output"]).rglob("*.parquet"))


def test_jobs_import_nothing_of_the_training_data_part():
    for p in [*ROOT.glob("jobs/*.py"), ROOT / "quarry/operators/index.py", ROOT / "tests/test_jobs.py"]:
        lines = [x for x in p.read_text().splitlines() if x.startswith(("import ", "from "))]
        assert not [x for x in lines if "llm" in x or "corpus_pipeline" in x]


def test_live_postings_are_not_moved(spark, tmp_path, monkeypatch):
    """Postings are read where they lie if few versions are replaced, and the rows are the same if many are."""
    from quarry.operators import index

    path, kind = f"{tmp_path}/index", T.LongType()
    for number, rows in enumerate(([(1, "fault throw fault"), (2, "sand")], [(1, "shale"), (3, None)])):
        index.add_batch(spark.createDataFrame(rows, "doc_id long, text string"), path, number)
    few = index.live_postings(spark, path, kind)
    want = [(1, "shale", 1), (2, "sand", 1)]
    assert sorted((r["id"], r["term"], r["n"]) for r in few.collect()) == want
    assert "SortMergeJoin" not in few._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(index, "FEW", 0)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sorted((r["id"], r["term"], r["n"]) for r in index.live_postings(spark, path, kind).collect()) == want
        monkeypatch.undo()
        assert "SortMergeJoin" not in index.live_postings(spark, path, kind)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
