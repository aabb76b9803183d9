import os
import subprocess
import sys

from touchline.llm.common import chunks, importable

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_workers_find_the_package_from_any_folder(tmp_path):
    code = (f"import sys; sys.path.insert(0, {ROOT!r})\n"
            "from touchline.session import get_spark\n"
            "from touchline.llm.fingerprints import fingerprints\n"
            "spark = get_spark('local[1]', shuffle_partitions=1)\n"
            "print('GOT', fingerprints(spark.createDataFrame([(1, 'a b c d e')], 'doc_id bigint, text string')).count())\n")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "GOT 1" in out.stdout, out.stderr[-2000:]


def test_path_is_added_once(spark):
    df = importable(importable(spark.range(1)))
    assert df.sparkSession.sparkContext.environment["PYTHONPATH"].split(os.pathsep).count(ROOT) == 1


def test_chunks_keep_order_and_long_texts():
    rows = [(i, b"x" * n) for i, n in enumerate((1, 5, 20, 1, 1))]
    got = list(chunks(rows, 6))
    assert [r for part in got for r in part] == rows and len(got) == 3


def test_rows_of_one_id_spread_over_homes(make_docs):
    from touchline.llm import lm_scoring, suffix_dedup
    from touchline.llm.common import home_of
    docs = make_docs([(i, f"text {k} of an id") for i in (None, 7) for k in range(400)])
    n = [r["count"] for r in docs.withColumn("home", home_of(8)).groupBy("doc_id", "home").count().collect()]
    assert len(n) == 16 and max(n) < 100
    for module in (lm_scoring, suffix_dedup):  # both deal their homes so
        assert module.home_of is home_of
