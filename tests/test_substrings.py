import random

import pytest
from pyspark.sql import functions as F

from manualdex.operators import substrings
from manualdex.plans import explain

ROWS = [
    (1, "Manual DS350.pdf", "/lib/a/1", "Гидроаккумулятор und ÄÖ 𝄞x𝄞 end"),
    (2, "readme.txt", "/lib/b/2", None),
    (3, None, "/lib/c/3", "aaaa aaab"),
    (4, "x", "", ""),
    (5, "tail.txt", "/lib/d/5", "q" * 40 + "needle" + "w" * 40),
    (6, "tail.txt", "/lib/d/6", "İstanbul ΣΑΣ"),
]
SCHEMA = "id long, filename string, filepath string, content string, extension string, block int, gram string"


@pytest.fixture(scope="module")
def files(spark):
    rng = random.Random(1)
    more = [(i, f"f{i}.txt", f"/lib/{i}", "".join(rng.choice("abc нй") for _ in range(rng.randint(0, 90)))) for i in range(10, 300)]
    return spark.createDataFrame([(*r, ".txt", 7, "g") for r in ROWS + more], SCHEMA).cache()


@pytest.fixture(scope="module")
def index(files, tmp_path_factory):
    return substrings.write_index(files, str(tmp_path_factory.mktemp("index")), block_rows=10, piece=17)


@pytest.mark.parametrize(
    "needle",
    ["DS350", "гидроАКК", "needle", "qqqqqqqq", "aaab", "ab", "", "abc", "a н", "𝄞x𝄞", "nowhere at all", "/lib/", "f29", "%_", "σας"],
)
def test_index_equals_scan(files, index, needle):
    assert explain.substring_probe_by_index(files, index, needle).collect() == explain.substring_probe(files, needle).collect()
    by_index = explain.substring_total_by_index(files, index, needle).collect()
    assert by_index == explain.substring_total(files, needle).collect()


def test_trigrams_of_pieces_are_those_of_the_text(spark):
    text = "abcdefghijklmnopqrstuvwxyzабв"
    whole = {text[i : i + 3] for i in range(len(text) - 2)}
    for chars in (1, 2, 5, 100):
        cut = spark.createDataFrame([(text,)], "t string").select(
            substrings.F.explode(substrings.pieces(substrings.F.col("t"), chars)).alias("p")
        )
        grams = cut.select(substrings.F.explode(substrings.trigrams(substrings.F.col("p"))).alias("g")).distinct()
        assert {r.g for r in grams.collect()} == whole


def test_only_blocks_with_candidates_are_read(spark, files, index):
    rows = substrings.candidate_rows(files, index, "needle")
    assert "dynamicpruning" in rows._jdf.queryExecution().toString()
    assert [r.id for r in rows.collect()] == [5]
    leaves = rows._jdf.queryExecution().executedPlan().finalPhysicalPlan().collectLeaves()
    scans = [leaves.apply(i) for i in range(leaves.size())]
    read = [x.metrics().apply("numFiles").value() for x in scans if "blocks" in x.toString()]
    assert read == [1] and index.blocks > 20


def test_rarest_trigrams_come_first(spark, files, index):
    chosen = substrings.chosen_grams(spark, index, "/lib/10")
    counts = [n for _, n in chosen]
    assert counts == sorted(counts) and counts[-1] <= substrings.COMMONER * counts[0]
    assert substrings.chosen_grams(spark, index, "nowhere") is None


def test_empty_catalog(spark, files, tmp_path):
    none = files.filter("id < 0")
    index = substrings.write_index(none, str(tmp_path / "none"))
    assert explain.substring_total_by_index(none, index, "needle").first().total == 0


def test_texts_are_cut_into_trigrams_once(spark, tmp_path):
    """Of each text the trigrams are worked out once, and the row is read once more for its block."""
    seen = spark.sparkContext.accumulator(0)

    def text(i):
        seen.add(1)
        return f"text {i % 7} of {i}"

    made = F.udf(text, "string").asNondeterministic()
    files = spark.range(0, 200, 1, 4).select(
        "id", F.lit("a").alias("filename"), F.lit("/a").alias("filepath"), made("id").alias("content")
    )
    index = substrings.write_index(files, str(tmp_path))
    assert seen.value == 400
    grams = index.read(spark, "grams")
    assert grams.count() == grams.distinct().count() and grams.filter("gram = 'ext'").count() == 200
