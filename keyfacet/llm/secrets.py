"""Secret scans with corpus-wide ownership frequency.

Every text is scanned once for candidates: the base kinds (``assign``, ``access``,
``hex``) and wider kinds that only count once the corpus speaks for them. The hash of each
candidate's value is then aggregated over the whole corpus by distinct repositories and
owners. A value that many owners hold is a copied example; one that a single owner holds
looks live. Wide candidates become spans only if they look live; base ones always stay.

Defined results: null text counts as empty; null owner or repository is one owner or
repository of its own; repeated rows are separate rows with equal results, each a use of its values; of spans that begin at
one place the kind decides the order; whole texts are scanned, however long; an empty table gives no rows; columns besides those
named, whatever their names, stay as they are and don't count.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyfacet.llm.common import Located, Marks, column, materialize, plain_scan, sliced, spare

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
# A run is taken whole, so asking for the least length in the pattern equals dropping short runs.
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
BASE_KINDS = ("assign", "access", "hex")
#: Kinds of the wider net: a substring that must be there, the pattern, the group with the value.
WIDE = (
    ("prefixed", "gh", re.compile(r"\bgh[opusr]_[A-Za-z0-9]{20,}"), 0),
    ("prefixed", "sk", re.compile(r"\bsk[-_](?:[a-z]+[-_])?[A-Za-z0-9]{20,}"), 0),
    ("prefixed", "xox", re.compile(r"\bxox[abeoprs]-[A-Za-z0-9-]{10,}"), 0),
    ("prefixed", "AIza", re.compile(r"\bAIza[A-Za-z0-9_-]{30,}"), 0),
    ("jwt", "eyJ", re.compile(r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"), 0),
    ("pem", "-----BEGIN", re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]*PRIVATE KEY-----"), 0),
    ("urlauth", "://", re.compile(r"[a-z][a-z0-9+.-]*://[^\s:/@]+:([^\s:/@]{6,})@"), 1),
)
HEXISH = frozenset("0123456789abcdefABCDEF")


def entropy(value: str) -> float:
    """Shannon entropy of a string in bits a character."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, end, kind number, value) of the base kinds, by start and then kind."""
    found = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), m.end(), 0, m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1, m[0]) for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), 2, m[0]) for m in HEX.finditer(text)]
    return sorted(found)


def wide_spans(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, value) of the wider kinds that touch no base span."""
    found = []
    for kind, hint, pattern, group in WIDE:
        if hint in text:
            for m in pattern.finditer(text):
                if not any(s < m.end() and m.start() < e for s, e, *_ in base):
                    found.append((m.start(), m.end(), kind, m[group]))
    return sorted(found)


CANDIDATE = "struct<kind:string,start:int,end:int,hash:string,entropy:double,wide:boolean>"


def scan(docs: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """``keep`` and ``candidates``, an array of candidate structs, of every row."""
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + f", candidates array<{CANDIDATE}>"
    text_at = list(dict.fromkeys([*keep, text_col])).index(text_col)
    kind = pa.list_(
        pa.struct(
            [("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("hash", pa.string()), ("entropy", pa.float64()), ("wide", pa.bool_())]
        )
    )

    def candidates(text: str | None) -> list[dict]:
        if not text:
            return []
        base = base_spans(text)
        rows = [(s, e, BASE_KINDS[k], v, False, k) for s, e, k, v in base]
        rows += [(s, e, k, v, True, 9) for s, e, k, v in wide_spans(text, base)]
        rows.sort(key=lambda r: (r[0], r[5], r[2]))
        return [
            {"kind": k, "start": s, "end": e, "hash": hashlib.sha256(v.encode("utf-8", "surrogatepass")).hexdigest(), "entropy": entropy(v), "wide": w}
            for s, e, k, v, w, _ in rows
        ]

    def run(batches):
        for b in sliced(batches):
            found = pa.array([candidates(t) for t in b.column(text_at).to_pylist()], kind)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), found], [*keep, "candidates"])

    return docs.select(*map(column, dict.fromkeys([*keep, text_col]))).mapInArrow(run, schema)


def ownership(cands: DataFrame, owner_col: str, repo_col: str, example_owners: int, example_repos: int) -> DataFrame:
    """One row per candidate hash: numbers of owners, repositories and uses, and the verdict.

    Counted in steps, (hash, owner, repository) first, so that a value copied into a third
    of all rows is spread over its repositories and combined before each shuffle.
    """
    per_repo = cands.groupBy("hash", F.col(owner_col).alias("_o"), F.col(repo_col).alias("_r")).agg(
        F.count("*").alias("n"), F.max("entropy").alias("entropy")
    )
    per_owner = per_repo.groupBy("hash", "_o").agg(
        F.count("*").alias("repos"), F.sum("n").alias("n"), F.max("entropy").alias("entropy")
    )
    return (
        per_owner.groupBy("hash")
        .agg(F.count("*").alias("n_owners"), F.sum("repos").alias("n_repos"), F.sum("n").alias("n_uses"), F.max("entropy").alias("entropy"))
        .withColumn(
            "verdict",
            F.when((F.col("n_owners") >= example_owners) | (F.col("n_repos") >= example_repos), "example")
            .when((F.col("n_owners") == 1) & (F.col("entropy") >= 2.5), "live")
            .otherwise("unclear"),
        )
    )


def scan_secrets(
    docs: DataFrame | Located,
    id_col: str = "doc_id",
    text_col: str = "text",
    owner_col: str = "source",
    repo_col: str = "doc_id",
    example_owners: int = 3,
    example_repos: int = 50,
    salts: int = 32,
) -> DataFrame:
    """``id_col``, ``row`` (its number in the table) and ``candidates`` (with ``verdict``, ``n_owners`` and ``n_repos``) of every row.

    The candidates are written once as a table. Verdicts return to them by an equi-join; hashes
    used more than 10,000 times are salted on both sides, so no join task gets a whole hot hash.
    """
    at = docs if isinstance(docs, Located) else Located(docs)
    numbered = at.numbered(spare(at.columns, "row")[0])
    inner = numbered.select(
        column(numbered.columns[-1]).alias("row"), column(id_col).alias("id"), column(owner_col).alias("owner"), column(repo_col).alias("repo"), column(text_col).alias("text")
    )
    scanned = materialize(scan(inner, "text", ["row", "id", "owner", "repo"]), "secrets")
    flat = scanned.select("row", "owner", "repo", F.posexplode("candidates").alias("pos", "c")).select("row", "owner", "repo", "pos", "c.*")
    verdicts = ownership(flat, "owner", "repo", example_owners, example_repos)
    hot = F.col("n_uses") > 10_000
    spread = verdicts.withColumn(
        "salt", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))
    ).withColumn("hot", hot)
    # Cold hashes are stored under salt 0 and hot ones under every salt; a use looks under both.
    uses = flat.withColumn("salt", F.explode(F.array(F.lit(0), F.pmod(F.xxhash64("row", "pos"), F.lit(salts - 1)).cast("int") + 1)))
    judged = uses.join(
        spread.filter("hot or salt = 0").select("hash", "salt", "hot", "n_owners", "n_repos", "verdict"), ["hash", "salt"]
    ).filter(F.col("hot") == (F.col("salt") > 0))
    per_row = judged.groupBy("row").agg(
        F.array_sort(
            F.collect_list(F.struct("pos", "kind", "start", "end", "hash", "entropy", "wide", "n_owners", "n_repos", "verdict"))
        ).alias("candidates")
    )
    none = F.array().cast(per_row.schema["candidates"].dataType)
    return scanned.select("id", "row").join(per_row, "row", "left").select(
        F.col("id").alias(id_col), column("row").alias(spare([id_col, "candidates"], "row")[0]), F.coalesce("candidates", none).alias("candidates")
    )


def spans(candidates: str = "candidates") -> F.Column:
    """Base candidates and the wide ones that look live."""
    return F.filter(candidates, lambda c: ~c["wide"] | (c["verdict"] == "live"))


def spans_text(col: F.Column) -> F.Column:
    return F.array_join(F.transform(col, lambda c: F.concat_ws(":", c["kind"], c["start"].cast("string"), c["end"].cast("string"))), ",")


def redact(docs: DataFrame | Located, found: DataFrame, text_col: str = "text", stays: str = "example") -> DataFrame:
    """Replace each span of ``docs`` that isn't judged ``stays``, a copied example, by ``[kind]``.

    ``found``: :func:`scan_secrets` of the same ``docs`` (as one :class:`~keyfacet.llm.common.Located` if they aren't
    a plain scan of Parquet files). Only rows with such a span are shuffled; all others stay where they are read.
    """
    if not isinstance(docs, Located) and not plain_scan(docs):
        raise ValueError("rows of such a table have no lasting numbers: pass one Located to scan_secrets and redact")
    at = docs if isinstance(docs, Located) else Located(docs)
    row, hashes_col = spare(at.columns, "row", "hashes")
    live = found.select(column(found.columns[1]).alias(row), F.filter(spans(), lambda c: c["verdict"] != stays)["hash"].alias(hashes_col))
    live = materialize(live.filter(F.size(hashes_col) > 0), "live")
    marks = Marks(at, live, row)

    @F.pandas_udf("string")
    def cut(texts, lives):
        import pandas as pd

        out = []
        for text, hashes in zip(texts, lives):
            if text and hashes is not None and len(hashes):
                base = base_spans(text)
                every = [(s, e, BASE_KINDS[k], v) for s, e, k, v in base] + wide_spans(text, base)
                hashes, parts, at = set(hashes), [], 0
                for s, e, k, v in sorted(every):
                    if hashlib.sha256(v.encode("utf-8", "surrogatepass")).hexdigest() in hashes and e > at:
                        parts += [text[at : max(s, at)], f"[{k}]" if s >= at else ""]
                        at = e
                text = "".join(parts) + text[at:]
            out.append(text)
        return pd.Series(out, dtype=object)

    dirty = at.pick(marks, row).join(live, row)
    texts = {c: cut(column(c), F.col(hashes_col)).alias(c) if c == text_col else column(c) for c in at.columns}
    return at.pick(marks, row, on=False).select(*map(column, at.columns)).unionByName(dirty.select(*texts.values()))
