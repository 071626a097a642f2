import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    """(id, text[, source]) rows as documents."""
    return spark.createDataFrame([(r[0], r[1], None, r[2] if len(r) > 2 else "s", None) for r in rows], DOCS).repartition(3)


def write(spark, tmp_path, df, name="documents"):
    df.write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)
