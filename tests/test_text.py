import math

from pyspark.sql import functions as F

from lodestone.functions import text
from lodestone.functions.stem import analyze, stem


def one(spark, col, **values):
    schema = ", ".join(f"{k} {'array<double>' if isinstance(v, list) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(col.alias("x")).first().x


def test_stemmer():
    for word, root in {"caresses": "caress", "ponies": "poni", "cats": "cat", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "hopping": "hop", "filing": "file", "happy": "happi", "relational": "relat", "conditional": "condit", "digitizer": "digit", "sensibility": "sensibl", "electrical": "electr", "adoption": "adopt", "probate": "probat", "controlling": "control", "sky": "sky", "is": "is"}.items():
        assert stem(word) == root
    assert analyze("The index was restarted, and the Indexes") == [("index", 2), ("restart", 4), ("index", 7)]


def test_snippets_and_docs(spark):
    assert one(spark, text.snippet(F.col("a")), a="a \n\t b" + "c" * 300) == ("a b" + "c" * 300)[:180]
    assert one(spark, text.code_snippet(F.col("a")), a="1\n2\n3\n4\n5") == "1\n2\n3\n4"
    assert one(spark, text.memory_doc(F.col("t"), F.col("s"), F.col("c")), t="T", s="", c="C") == "T\nC"
    assert one(spark, text.code_doc(F.col("p"), F.col("c")), p="p", c="x" * 2000) == ("p\n" + "x" * 2000)[:1500]


def test_budget_and_lines(spark):
    b = one(spark, text.budget_body(F.col("a"), 3), a="abcde")
    assert (b.content, b.truncated, b.total_chars) == ("abc", True, 5)
    assert one(spark, text.budget_body(F.col("a"), 0), a="abcde").truncated is False
    assert one(spark, text.budget_body(F.col("a"), 3), a=None).content is None
    assert one(spark, text.line_range(F.col("a"), 2, 3), a="x\ny\nz\nw") == "2\ty\n3\tz"


def test_symbol_and_cosine(spark):
    s = one(spark, text.symbol(F.col("a")), a="// no\nexport default async function go$1() {}")
    assert (s.name, s.kind) == ("go$1", "function")
    assert one(spark, text.symbol(F.col("a")), a="nothing").name is None
    assert math.isclose(one(spark, text.cosine(F.col("a"), F.col("b")), a=[1.0, 0.0], b=[1.0, 1.0]), math.sqrt(0.5))
    assert one(spark, text.cosine(F.col("a"), F.col("b")), a=[0.0, 0.0], b=[1.0, 1.0]) is None
