"""Plain Python versions of what the operators share."""

import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def docs(spark, texts, sources=None):
    """Documents of the given texts; ids count from 1."""
    rows = [(i + 1, t, "en", (sources or ["s"] * len(texts))[i], len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def written(frames, folder):
    """Tables as a folder of Parquet, as the registered queries read them."""
    for name, df in frames.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)
