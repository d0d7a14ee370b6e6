"""SQL names for the functions: UDFs, a grouped mean of vectors, and table functions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def register(spark: SparkSession) -> None:
    """Register ``kf_stem``, ``kf_sentences`` (row functions), ``kf_mean_vector`` (aggregate), ``kf_sections``, ``kf_chunks`` and ``kf_tokens`` (table functions)."""
    from keyfacet.functions.stem import stem

    @F.pandas_udf(T.StringType())
    def kf_stem(word: pd.Series, lang: pd.Series) -> pd.Series:
        return pd.Series([None if w is None else stem(w.lower(), g) for w, g in zip(word, lang)], dtype=object)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def kf_mean_vector(vector: pd.Series) -> float:
        import numpy as np

        from keyfacet.plans.models import average_unit_vector

        return average_unit_vector(np.stack([np.asarray(v) for v in vector])).astype(float).tolist()

    from pyspark.sql.udtf import UserDefinedTableFunction

    def table_function(cls, kind):
        return UserDefinedTableFunction(cls, T.StructType.fromDDL(kind))

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def kf_sentences(text: pd.Series) -> pd.Series:
        from keyfacet.functions.text import sentences_of

        return pd.Series([None if t is None else sentences_of(t) for t in text], dtype=object)

    class Sections:
        """Sections of a markdown text."""

        def eval(self, text: str) -> Iterator[tuple]:
            from keyfacet.operators.chunk import sections_of

            for i, (headers, body) in enumerate(sections_of(text)):
                yield i, headers, body

    class Chunks:
        """Chunks of a markdown text, of at most so many tokens each, from sections of more than a least number."""

        def eval(self, text: str, max_tokens: int, min_section_tokens: int) -> Iterator[tuple]:
            from keyfacet.operators.chunk import chunks_of

            yield from chunks_of(text, max_tokens, min_section_tokens)

    class Tokens:
        """Words of a text with their places."""

        def eval(self, text: str) -> Iterator[tuple]:
            import re

            for i, m in enumerate(re.finditer(r"[\w-]+", (text or "").lower())):
                yield i, m[0], m.start(), m.end()

    spark.udf.register("kf_stem", kf_stem)
    spark.udf.register("kf_mean_vector", kf_mean_vector)
    spark.udf.register("kf_sentences", kf_sentences)
    spark.udtf.register("kf_sections", table_function(Sections, "section_no int, headers array<string>, body string"))
    spark.udtf.register("kf_chunks", table_function(Chunks, "section_no int, chunk_no int, headers array<string>, text string"))
    spark.udtf.register("kf_tokens", table_function(Tokens, "position int, word string, start int, stop int"))
