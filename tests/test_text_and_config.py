import pytest
from pyspark.sql import functions as F

from querysmith import config
from querysmith.functions import text
from querysmith.sources import tables


@pytest.mark.parametrize(
    ("word", "stem"),
    [
        ("caresses", "caress"), ("ponies", "poni"), ("ties", "tie"), ("caress", "caress"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"), ("plastered", "plaster"), ("bled", "bled"), ("motoring", "motor"), ("sing", "sing"),
        ("conflated", "conflat"), ("troubled", "troubl"), ("sized", "size"), ("hopping", "hop"), ("tanned", "tan"), ("falling", "fall"), ("hissing", "hiss"), ("fizzed", "fizz"), ("failing", "fail"), ("filing", "file"), ("happy", "happi"),
        ("relational", "relat"), ("conditional", "condit"), ("rational", "ration"), ("digitizer", "digit"), ("radically", "radic"), ("vietnamization", "vietnam"), ("predication", "predic"), ("operator", "oper"), ("feudalism", "feudal"),
        ("decisiveness", "decis"), ("hopefulness", "hope"), ("callousness", "callous"), ("formality", "formal"), ("sensitivity", "sensit"), ("triplicate", "triplic"), ("formative", "form"), ("formalize", "formal"), ("electrical", "electr"),
        ("hopeful", "hope"), ("goodness", "good"), ("revival", "reviv"), ("allowance", "allow"), ("inference", "infer"), ("airliner", "airlin"), ("adjustable", "adjust"), ("irritant", "irrit"), ("replacement", "replac"), ("adoption", "adopt"),
        ("communism", "commun"), ("activate", "activ"), ("effective", "effect"), ("bowdlerize", "bowdler"), ("probate", "probat"), ("rate", "rate"), ("cease", "ceas"), ("controll", "control"), ("roll", "roll"), ("Running", "run"), ("at", "at"), ("dying", "die"),
    ],
)
def test_stem(word, stem):
    assert text.stem(word) == stem


def tokens(spark, s):
    return spark.createDataFrame([(s,)], "s string").select(text.tokens(F.col("s")).alias("t")).first().t


def test_tokens(spark):
    assert tokens(spark, "A.B c-d e'f don't") == ["AB", "c-d", "ef", "dont"]
    assert tokens(spark, "I cannot--really “go”\tgonna") == ["I", "can", "not", "--", "really", "“", "go", "”", "gon", "na"]
    assert tokens(spark, None) == []


@pytest.mark.parametrize("token", ["Title", "tITLE", "ABC", "A1b", "A1B", "1", "", "Ünï", "O'Neil", "iPhone", "USA1", "Ab Cd", "X"])
def test_shapes_are_those_of_python(spark, token):
    row = spark.createDataFrame([(token,)], "t string").select(text.is_title(F.col("t")).alias("a"), text.is_upper(F.col("t")).alias("b"), text.has_non_alpha(F.col("t")).alias("c")).first()
    assert (row.a, row.b, row.c) == (token.istitle(), token.isupper(), any(not c.isalpha() for c in token))


def test_subsequences(spark):
    df = spark.createDataFrame([([1, 2, 1, 2, 1], [1, 2, 1]), ([1], [1, 2]), ([1, 2], [])], "s array<int>, p array<int>")
    assert [r.m for r in df.select(text.matches_at(F.col("s"), F.col("p")).alias("m")).collect()] == [[0, 2], [], []]
    assert df.select(text.truncated(F.col("s"), 4, 1).alias("t")).first().t == [1, 2, 1]


def test_csv_and_upsert(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_bytes('id,title,body\n1,a,"x ""q"", y\nz"\n2,caf\xe9,\n1,c,last\n'.encode("latin-1"))
    df = tables.read_entities(spark, str(path))
    rows = df.collect()
    assert tables.header(df) == ["id", "title", "body"] and rows[0].body == 'x "q", y\nz' and rows[1].title == "café"
    last = tables.upsert_by_id(df.withColumn("pos", F.monotonically_increasing_id()), "id", "pos").orderBy("first_pos").collect()
    assert [(r.id, r.title) for r in last] == [("1", "c"), ("2", "café")]
    assert tables.lookup(df, "2", True).first().row == "2|café|"


def test_cache_and_log(spark, tmp_path):
    made = []
    make = lambda: made.append(1) or spark.range(5)
    for _ in range(2):
        assert tables.cached_table(spark, f"{tmp_path}/c", make, "id", 2).count() == 5
    assert made == [1]
    log = spark.createDataFrame([(1, 1, 0.5), (2, 1, 1.0)], "run_id long, interaction long, rr double")
    tables.write_log(log, f"{tmp_path}/log")
    tables.write_log(log.filter("run_id = 2"), f"{tmp_path}/log")
    assert spark.read.parquet(f"{tmp_path}/log").filter("run_id = 2").count() == 2


def test_configuration(tmp_path):
    path = tmp_path / "paths"
    path.write_text("processed_data|/x\nverbose|true\nquiet|false\n")
    assert config.load_paths(str(path)) == {"processed_data": "/x", "verbose": True, "quiet": False}
    assert config.result_name({"dataset_name": "d", "query_length": 4}, ["dataset_name", "query_length", "none"]) == "da_na=d-qu_le=4"
    run = config.parse("--dataset d --iterations 10 --keys 2 --ts_features true --seeds 7,8 --average_runs 3".split())
    assert run.policy.external_feat_specific and run.buffer_size if hasattr(run, "buffer_size") else run.policy.buffer_size == 50
    assert [run.seed(i) for i in (1, 2, 3)] == [7, 8, 3]
    with pytest.raises(SystemExit):
        config.parse(["--dataset", "d"])
    assert len(config.sweep(run, alpha=[0.1, 0.2], query_length=[1, 2, 3])) == 6
    assert "hybrid" in config.save_path("/r", config.RunConfig(model="hybrid"))
    with pytest.raises(ValueError):
        config.RunConfig(model="other")
