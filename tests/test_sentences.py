"""Sentences are cut as their SQL cuts them, whatever they begin and end with."""

from pyspark.sql import functions as F

from clauseframe.functions import text as T
from clauseframe.plans import clauses as C


def cut(spark, text):
    return spark.createDataFrame([(text,)], "text string").select(T.sentences("text")).first()[0]


def test_digits_at_either_end_stay(spark):
    assert cut(spark, "Go to a.\n11 is 1.\n1 b 1\n2 c 2") == ["Go to a.", "11 is 1. 1 b 1 2 c 2"]
    assert cut(spark, "a b. 1 c d; 2 e 2! 3 f 3") == ["a b.", "1 c d;", "2 e 2! 3 f 3"]


def test_spaces_go_and_only_spaces_end_a_sentence(spark):
    assert cut(spark, "  a b. \u00a0c d.\u3000 \n e f") == ["a b.", "c d.", "e f"]
    assert cut(spark, "a b.\x0bc d.\x01e f") == ["a b.\x0bc d.", "e f"]
    assert cut(spark, None) == cut(spark, " \n.\n") == []


def test_lines_of_a_clause_keep_their_digits(spark):
    clauses = spark.createDataFrame([(1, 0, "C1", " 0 head 0\n1 a 1", "0 head 0")], "contract_id int, ord int, clause_id string, text string, heading string")
    assert [r.sentence for r in C.with_sentences(clauses).orderBy(F.col("s_ord")).collect()] == ["0 head 0", "1 a 1"]
