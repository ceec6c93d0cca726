import gzip

import golden
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolemill.plans.labelling import Settings, Stage, evaluate_run, fit_stage, score_pipeline
from rolemill.sources import arff, conll, lexicons
from rolemill.tables import domain_of


def test_conll_round_trip(spark, tmp_path):
    (tmp_path / "a.txt").write_text(golden.conll() + "\n  \n" + golden.conll())
    tokens, args = conll.read_conll(spark, str(tmp_path / "a.txt"))
    assert [r["sent_id"] for r in tokens.select("sent_id").distinct().orderBy("sent_id").collect()] == [1, 2]
    first = tokens.filter("sent_id = 1").orderBy("word_id").collect()
    assert [r["form"] for r in first] == [r[1] for r in golden.rows()]
    assert args.filter("sent_id = 2").count() == golden.args(spark).count()
    conll.write_conll(tokens, args, str(tmp_path / "out"))
    lines = "\n".join(r["value"] for r in spark.read.option("lineSep", "\n\n").text(str(tmp_path / "out")).collect())
    assert lines.strip() == "\n".join([golden.conll().strip()] * 2)


def test_conll_files_keep_their_order(spark, tmp_path):
    for name in "bac":
        (tmp_path / f"{name}.txt").write_text(f"1\t{name}1\n2\t{name}2\n\n1\t{name}3\n\n")
    tokens, _ = conll.read_conll(spark, str(tmp_path))
    forms = [r["form"] for r in tokens.orderBy("sent_id", "word_id").collect()]
    assert forms == ["a1", "a2", "a3", "b1", "b2", "b3", "c1", "c2", "c3"]


def test_evaluation_file_has_missing_fields(spark, tmp_path):
    (tmp_path / "e.txt").write_text("1\tA\ta\ta\tNN\tNN\t_\t_\t0\t0\tR\tR\tY\n\n")
    tokens, args = conll.read_conll(spark, str(tmp_path / "e.txt"))
    assert tokens.first()["pred"] is None and args.isEmpty()


def test_language_config():
    lang = conll.Language.parse("\nN.*\nV.*\nA0 A1\nAM-.*\nx y\n")
    assert (lang.feature_handler, lang.noun, lang.roles, lang.extra_columns) == (None, "N.*", ("A0", "A1"), ("x", "y"))


def test_arff(spark, tmp_path):
    text = '@relation r\n% note\n@attribute n numeric\n@attribute "s t" string\n@attribute c {"a b",\'c\'}\n@data\n1,"x, \\"y\\"",?\n2.5,?,"a b"\n'
    (tmp_path / "a.arff").write_text(text)
    with gzip.open(tmp_path / "b.arff.gz", "wt") as f:
        f.write(text)
    one, two = (arff.read_table_arff(spark, str(tmp_path / n)) for n in ("a.arff", "b.arff.gz"))
    assert [tuple(r) for r in one.collect()] == [(1.0, 'x, "y"', None), (2.5, None, "a b")] == [tuple(r) for r in two.collect()]
    arff.write_table_arff(one, str(tmp_path / "out"), "again")
    back = arff.read_table_arff(spark, str(tmp_path / "out"))
    assert back.exceptAll(one).isEmpty() and back.count() == 2
    with pytest.raises(ValueError):
        arff.parse_header(["@attribute d date"])


def test_domains_are_sorted_in_the_header(spark):
    df = spark.createDataFrame([("b",)], "c string").withMetadata("c", {"nominal": ["b", "a"]})
    assert '@attribute c {"a","b"}' in arff.header_lines(df, "r")
    assert domain_of(df, "c") == ["b", "a"]


def test_sparse_rows(spark):
    schema = T.StructType([T.StructField("n", T.DoubleType()), T.StructField("c", T.StringType(), True, {"nominal": ["p", "q"]}), T.StructField("s", T.StringType())])
    df = spark.createDataFrame([("{0 5,2 'x y'}",), ("{1 q, 2 ?}",), ("% no",)], "value string")
    assert [tuple(r) for r in arff.read_sparse_rows(df, schema).collect()] == [(5.0, "p", "x y"), (0.0, "q", None)]


def test_side_files(spark, tmp_path):
    (tmp_path / "c.txt").write_text("1 4\n17: word1 a:b\n3: word1\n")
    cols, lookup = lexicons.read_clusters(spark, str(tmp_path / "c.txt"))
    assert cols == [1, 4] and {r["word"]: r["cluster"] for r in lookup.collect()} == {"word1": 3, "a:b": 17}
    (tmp_path / "p.txt").write_text("take.01.v:10:A0 10 A1 9:A1 A0\n\nsit.n:2\n")
    info = {r["pred"]: r for r in lexicons.read_predinfo(spark, str(tmp_path / "p.txt")).collect()}
    assert info["take.01.v"]["frame"] == ["A0", "A1"] and info["take.01.v"]["count"] == 10
    assert info["sit.n"]["frame"] is None and info["sit.n"]["pos"] == "n"
    (tmp_path / "f.xml").write_text('<x>\n<roleset id="go.01" name="g" vncls="51">\n<role descr="t" n="0"/>\n<role n="2" f="x"/>\n<role f="tmp" n="m"/>\n</roleset>\n<roleset id="go.02">\n</roleset>')
    frames = {r["pred"]: r for r in lexicons.read_framesets(spark, str(tmp_path / "f.xml")).collect()}
    assert frames["go.01"]["frame"] == ["A0", "A2", "AM-TMP"] and frames["go.01"]["vncls"] == "51"
    assert frames["go.02"]["frame"] == []


def test_partitioned_output(spark, tmp_path):
    df = spark.range(500).select("id", F.when(F.col("id") < 400, "hot").otherwise("a/b").alias("k"))
    lexicons.write_partitioned(df, "k", str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).exceptAll(df).isEmpty()


def test_two_stage_run(spark):
    tokens = golden.tokens(spark).filter("sent_id = 1")
    lang = conll.Language(noun="N.*", verb="V.*")
    gold = tokens, golden.args(spark)
    found = score_pipeline(*gold, *gold, tokens, lang, Settings(chunks=2, steps=30))
    text = found.text().first()["text"]
    lines = [line.split("\t") for line in text.split("\n")]
    assert len(lines) == 25 and all(len(x) == 18 for x in lines)
    assert lines[6][13] == "take.01" and lines[0][13] == "_"
    assert any(role.startswith("A") for x in lines for role in x[14:])
    figures = {(r["stage"], r["kind"]): r for r in evaluate_run(*gold, found).collect()}
    assert figures["senses", "labeled"]["f1"] == 1.0 and figures["senses", "labeled"]["n"] == 4
    assert figures["roles", "unlabeled"]["tp"] >= figures["roles", "labeled"]["tp"] > 0


def test_stage_by_key(spark, tmp_path):
    """Keys with one label, with and without development rows, unknown ones; saved and loaded."""
    rows = [("p", f"x{i % 2}", f"n{i % 5}", "A" if i % 2 else "B") for i in range(20)] + [("o", f"x{i % 2}", f"n{i % 5}", "B" if i % 2 else "A") for i in range(20)]
    rows += [("u", "x1", "n1", "C"), ("u", "x0", "n2", "C"), (None, "x1", "n1", "A"), (None, "x0", "n1", "B")]
    train = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, part_key string, a string, b string, label string")
    dev = train.filter("part_key = 'p'")
    s = Settings(methods=("mi", "average"), orphan_columns=1)
    stage = fit_stage(train, dev, "label", ["a", "b"], ["id"], s)
    assert {(r["part_key"], tuple(r["use"])) for r in stage.chosen.collect()} == {("p", ("a",)), ("o", ("a",)), (None, ())}
    stage.save(str(tmp_path / "stage"))
    again = Stage.load(spark, str(tmp_path / "stage"))
    test = train.unionByName(spark.createDataFrame([(99, "new", "x1", "n1", "?")], train.schema)).withColumn("gold", F.col("label"))
    for st in (stage, again):
        got = {r["id"]: (r["part_key"], r["gold"], r["label"]) for r in st.apply(test, ["id"]).collect()}
        assert all(g == p for k, g, p in got.values() if k in ("p", "o", "u")) and got[99][2] is None
        probs = {r["id"]: r for r in st.apply(test, ["id"], ["A", "B", "C"]).collect()}
        assert probs[99]["label_A"] == 0 and [r["label_C"] for r in probs.values() if r["part_key"] == "u"] == [1.0, 1.0]


def test_arff_of_other_tools(spark, tmp_path):
    text = """@RELATION 'r 1'
@ATTRIBUTE 'a b' {'p, q','?', "it's"}
@attribute n REAL
@attribute s string
@data
% a note, 'x'
'p, q', 1.5 , 'line\\nbreak, "quoted" \\'x\\' \\\\n'
'?',?,?
  "it's" ,-2e3,plain text
{0 "it's", 2 'x, y'}
{1 7}
?,bad,"@data"
"""
    (tmp_path / "a.arff").write_text(text)
    df = arff.read_table_arff(spark, str(tmp_path / "a.arff"))
    assert domain_of(df, "a b") == ["p, q", "?", "it's"]
    assert [tuple(r) for r in df.collect()] == [
        ("p, q", 1.5, 'line\nbreak, "quoted" \'x\' \\n'), ("?", None, None), ("it's", -2000.0, "plain text"),
        ("it's", 0.0, "x, y"), ("p, q", 7.0, None), (None, None, "@data")]
    odd = spark.createDataFrame([("?", "a\nb\r\t\\n"), (None, "'q' \"q\","), ("", "x" * 50_000), ("{0 1}", "% no note")], "u string, v string")
    arff.write_table_arff(odd, str(tmp_path / "odd"))
    assert sorted(map(str, arff.read_table_arff(spark, str(tmp_path / "odd")).collect())) == sorted(map(str, odd.collect()))


def test_conll_with_two_line_ends(spark, tmp_path):
    text = "1\ta\n2\tb\n\n1\tc\n\n"
    for name, t in (("lf", text), ("crlf", text.replace("\n", "\r\n"))):
        (tmp_path / name).write_bytes(t.encode())
        tokens, _ = conll.read_conll(spark, str(tmp_path / name))
        assert [(r["sent_id"], r["form"]) for r in tokens.orderBy("sent_id", "word_id").collect()] == [(1, "a"), (1, "b"), (2, "c")]


def test_cells_of_a_wide_sentence(spark):
    """A line has a cell per predicate; its expression visits roles, not cells."""
    words = [(1, i, f"w{i}", "Y" if i <= 300 else "_") for i in range(1, 302)]
    tokens = spark.createDataFrame(words, "sent_id long, word_id int, form string, fillpred string")
    roles = [(1, 300, 1, "Z"), (1, 1, 1, "A"), (1, 7, 1, None), (1, 301, 1, "past"), (1, 0, 1, "before"), (1, 2, 301, "B")]
    args = spark.createDataFrame(roles, "sent_id long, pred_no int, word_id int, role string")
    out = conll.conll_text(tokens, args)
    lines = [x.split("\t")[len(conll.FIELDS):] for x in out.first()["text"].split("\n")]
    assert [len(x) for x in lines] == [300] * 301
    assert lines[0] == ["A", *["_"] * 298, "Z"] and lines[300] == ["_", "B", *["_"] * 298] and set(lines[1]) == {"_"}
    longs = conll.conll_text(tokens, args.withColumn("pred_no", F.col("pred_no").cast("long")))
    assert longs.first()["text"] == out.first()["text"]
    assert "sequence(" not in out._jdf.queryExecution().optimizedPlan().toString()
