import re

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
# Rows of every odd kind: null, empty and wordless texts, repeated rows, equal and null ids, a very long text.
ODD = [(900001, None), (900002, ""), (900003, " \n\t"), (900004, "123 %%"), (900005, "x y"), (900005, "x y"), (900006, "X, y!"), (None, "alone é"), (900007, "'s\n's a  b　\u0085z"), (900008, "lorem ipsum dolor. " * 20000), (900009, "a" * 300)]


def documents(spark, folder, odd=True):
    """Texts with clashing extra columns."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("doc_id", "text", "lang", "source", "n_chars", "1 as score", "2 as n_words", "'q' as `row`", "3 as id")
    if not odd:
        return docs
    more = spark.createDataFrame([(i, t, "en", "src1", 0, 1, 2, "q", 3) for i, t in ODD], "doc_id bigint, text string, lang string, source string, n_chars bigint, score int, n_words int, `row` string, id int")
    return docs.unionByName(more)


def words(text):
    return WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
