r"""Sentences, tokens, words and proximity as column expressions.

Differences from a Python implementation: ``\s`` and digits are ASCII in the sentence pattern, and the
word class is letters, numbers, ``_`` and ``-``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The code points that a full Unicode strip removes.
BLANK = r"\t-\r\x1c-\x20\x85\xa0  -     　"
#: The same, each by itself.
BLANKS = "".join(c for c in map(chr, range(0x3001)) if re.match(f"[{BLANK}]", c))
#: A break after a line end, over spaces after a full stop, or before the number of a list item.
BREAK = r"(?<=\n)|(?<=[!.?])\x20+|(?=\s*(?<![0-9][!.?])(?<![0-9])[0-9]+\.\s)"
ENUMERATOR = r"^[!.?]?\s*[0-9]+\."
WORD = r"[\p{L}\p{N}_\-]+"
TOKEN = r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"
#: Every line end that splits lines, CR LF first.
LINE = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85  ]"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{BLANK}]+|[{BLANK}]+$", "")


def sentences(text: Column) -> Column:
    """Array of sentences. The number of a list item is glued to the piece after it, even an empty one."""
    pieces = F.transform(F.split(text, BREAK, -1), strip)
    plain = F.filter(pieces, lambda s: s != "")
    none = F.lit(None).cast("string")
    start = F.struct(F.array().cast("array<string>").alias("out"), none.alias("held"))

    def step(acc: Column, s: Column) -> Column:
        holding = acc["held"].isNotNull()
        number = s.rlike(ENUMERATOR)
        add = F.when(holding, strip(F.concat(acc["held"], F.lit(" "), s))).when((s != "") & ~number, s)
        return F.struct(
            F.when(add.isNotNull(), F.array_append(acc["out"], add)).otherwise(acc["out"]).alias("out"),
            F.when(~holding & (s != "") & number, s).otherwise(none).alias("held"),
        )

    folded = F.aggregate(
        pieces, start, step, lambda a: F.when(a["held"].isNotNull(), F.array_append(a["out"], a["held"])).otherwise(a["out"])
    )
    # The fold copies its array at each step, so it is kept for texts that may hold a list item.
    return F.when(text.rlike(r"[0-9]\."), folded).otherwise(plain)


TOKEN_PY = re.compile(r"\w+|[^ \t\n\x0b\f\r\w]")
_BREAK_PY, _HEAD_PY = re.compile(BREAK, re.A), re.compile(ENUMERATOR, re.A)
_ENDS_PY = re.compile(f"^[{BLANK}]+|[{BLANK}]+\\Z")


def sentences_of(text: str) -> list[str]:
    """:func:`sentences` of one text in Python, for the SQL function."""
    out, held = [], None
    for piece in _BREAK_PY.split(text):
        s = _ENDS_PY.sub("", piece)
        if held is not None:
            out.append(_ENDS_PY.sub("", f"{held} {s}"))
            held = None
        elif s and _HEAD_PY.match(s):
            held = s
        elif s:
            out.append(s)
    return out if held is None else [*out, held]


def token_count(text: Column) -> Column:
    """Stand-in for a byte-pair tokenizer: runs of letters and digits, and single marks."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), 0)


def long_enough(stems: Column) -> Column:
    return F.filter(stems, lambda s: F.length(s) > 1)


def stem_tokens(text: Column, lang: Column | None = None) -> Column:
    """Stems in order, with repeats, without those of one character; without ``lang`` the words themselves."""
    if lang is None:
        return F.coalesce(long_enough(words(text)), F.array().cast("array<string>"))
    from keyfacet.functions.stem import stem_words

    return F.coalesce(long_enough(stem_words(words(text), lang)), F.array().cast("array<string>"))


def keypoint_stems(text: Column, lang: Column | None = None) -> Column:
    return F.array_distinct(stem_tokens(text, lang))


def sentence_stems(text: Column, lang: Column | None = None) -> Column:
    """Distinct stems of each sentence; sentences without stems are dropped."""
    if lang is None:
        stems = F.transform(sentences(text), lambda s: F.array_distinct(stem_tokens(s)))
    else:
        from keyfacet.functions.stem import stem_nested

        stems = F.transform(
            stem_nested(F.transform(sentences(text), words), lang), lambda w: F.array_distinct(long_enough(w))
        )
    return F.filter(stems, lambda s: F.size(s) > 0)


def stem_set(nested: Column) -> Column:
    """Distinct stems of all sentences in order of first use."""
    return F.array_distinct(F.flatten(nested))


def contains_all(nested: Column, required: Column) -> Column:
    """Some sentence holds every required stem; true if none is required.

    Stems made by a stemmer have to be columns already: Spark takes no Python function inside a lambda.
    """
    return (F.size(required) == 0) | F.exists(nested, lambda s: F.size(F.array_except(required, s)) == 0)


def clean_keypoints(items: Column, distinct: bool = True) -> Column:
    """Stripped, without nulls and blanks; distinct ones keep the order of first use."""
    kept = F.filter(F.transform(items, strip), lambda x: x.isNotNull() & (x != ""))
    return F.array_distinct(kept) if distinct else kept


def node_keypoints(header: Column, phrases: Column) -> Column:
    return F.array_distinct(F.concat(F.array(header), phrases))


def header_prefix(headers: Column) -> Column:
    return F.array_join(F.transform(headers, lambda h, i: F.concat(F.repeat(F.lit("#"), i + 1), F.lit(" "), h)), "\n")


def header_path(headers: Column) -> Column:
    return F.array_join(headers, " > ")


def sample(text: Column, chars: int = 2000) -> Column:
    return F.substring(strip(text), 1, chars)


def pack_numbers(tokens: Column, max_tokens: int) -> Column:
    """For an array of sentence sizes, the number of the chunk that each sentence goes to.

    A chunk closes when it isn't empty and the next sentence would take it over the limit.
    """
    start = F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("chunk"), F.lit(0).alias("used"))

    def step(acc: Column, n: Column) -> Column:
        full = (F.size(acc["out"]) > 0) & (acc["used"] + n > max_tokens)
        number = F.when(full, acc["chunk"] + 1).otherwise(acc["chunk"])
        return F.struct(
            F.array_append(acc["out"], number).alias("out"), number.alias("chunk"), F.when(full, n).otherwise(acc["used"] + n).alias("used")
        )

    return F.aggregate(F.transform(tokens, lambda n: n.cast("int")), start, step, lambda a: a["out"])
