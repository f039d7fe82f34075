"""Small inputs that every document operator has to take."""

from pyspark.sql import types as T

DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
])

PROSE = "the quick brown fox jumps over the lazy dog while seven wizards brew potent elixirs beneath an indigo moon "


def rows():
    long = " ".join(f"word{i * 7919 % 10007}" for i in range(30_000))
    texts = [PROSE * 5, PROSE * 5, None, "", " ", "a", "été — naïve 漢字 \U0001f600", "x" * 5000, long, "one two three", PROSE * 5 + "tail", "\n\n a  b\t c \x0b d\r\n", "<|endoftext|> and <s>"]
    out = [(i, t, "en", None if i % 5 == 4 else f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    return [*out, out[0], (None, PROSE * 3, None, None, None), (None, None, None, None, None)]


def documents(spark, data=None, clash=False):
    df = spark.createDataFrame(rows() if data is None else data, DOCUMENTS)
    if clash:  # names that the operators use inside
        for name in ("length", "size", "h", "b1", "rest", "key", "rank", "score", "ids", "copy", "row", "base", "salt", "threshold"):
            df = df.withColumn(name, df["lang"])
    return df
