"""Secret scans with an incremental ledger of blobs.

Every version of a text is addressed by the SHA-256 of its content. The ledger, a table in a folder that all share, says
which (blob, rule and version) pairs have been scanned and what was found; only pairs that it lacks are scanned, each
distinct text once, and appended; the findings are joined back to every row that has the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alphaloom.llm.common import blocks, free_name, on_executors, scratch_path, spread_join, text_of

#: The rules with their versions, in order. The first three are the base; their letters are ASCII.
RULES = {
    "assign": "1",
    "access": "1",
    "hex": "1",
    "pem": "2",
    "jwt": "1",
}
BASE = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ASSIGN_HINTS = ("passw", "secret", "token", "api")
# A run of these characters is either matched whole or too short at any place, so the length can be part of the pattern.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_PEM = re.compile(r"-----BEGIN ([A-Z ]{0,40}PRIVATE KEY)-----")
# What follows a BEGIN line without its END line: header lines and base64, whose line ends may be written as \\n.
_PEM_BODY = re.compile(r"(?:(?:\s|\\[nr])*+(?:(?:Proc-Type|DEK-Info):[^\r\n\\]*+|[A-Za-z0-9+/]{16,}+={0,2}+|[A-Za-z0-9+/]++={1,2}+))*+")
_JWT = re.compile(r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}")
_SPANS = "array<struct<kind:string,start:long,end:long>>"
_LEDGER = f"blob binary, rule string, spans {_SPANS}"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find(rule: str, text: str) -> list[tuple[int, int]]:
    """(start, end) of the rule's secrets in the text, in code points, end exclusive."""
    if rule == "assign":
        low = text.lower()
        if not any(h in low for h in _ASSIGN_HINTS):
            return []
        return [m.span() for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if rule == "access":
        return [m.span() for m in _ACCESS.finditer(text)] if "AKIA" in text else []
    if rule == "hex":
        return [m.span() for m in _HEX.finditer(text)]
    if rule == "pem":
        return _pem(text) if "-----BEGIN " in text else []
    if rule == "jwt":
        return [m.span() for m in _JWT.finditer(text)] if "eyJ" in text else []
    raise ValueError(f"no rule {rule!r}")


def _pem(text: str) -> list[tuple[int, int]]:
    """From each BEGIN line to its END line if that comes before the next BEGIN line, else over the key's lines after it."""
    begins = list(_PEM.finditer(text))
    spans = []
    for m, after in zip(begins, [*begins[1:], None], strict=True):
        limit = after.start() if after else len(text)
        last = f"-----END {m[1]}-----"
        at = text.find(last, m.end(), limit)
        spans.append((m.start(), at + len(last) if at >= 0 else _PEM_BODY.match(text, m.end(), limit).end()))
    return spans


def _scan(rules: dict[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f"{r}@{v}" for r, v in rules.items()]
        for batch, texts in blocks(batches, "text"):
            at = batch.schema.get_field_index("done")
            done = batch.column(at).to_pylist() if at >= 0 else [()] * len(texts)
            blob, rule, spans = [], [], []
            for b, text, seen in zip(batch.column(0).to_pylist(), texts, done, strict=True):
                for name, r in zip(names, rules, strict=True):
                    if name not in (seen or ()):
                        blob.append(b)
                        rule.append(name)
                        spans.append([{"kind": r, "start": i, "end": j} for i, j in find(r, text)])
            yield pa.RecordBatch.from_arrays([pa.array(blob, pa.binary()), pa.array(rule, pa.string()), pa.array(spans, _ARROW)], names=["blob", "rule", "spans"])

    return run


def blob_of(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def scan(docs: DataFrame, ledger: DataFrame | None = None, rules: dict[str, str] | None = None) -> DataFrame:
    """The ledger (blob binary, rule string `name@version`, spans) of docs' texts that `ledger` lacks: one row for each unseen pair, found or not.

    docs: a column text, null counting as empty; every row is a path to its blob. Append the result to the ledger.
    """
    rules = RULES if rules is None else rules
    on_executors(docs.sparkSession)
    text = text_of()
    blobs = docs.select(blob_of(text).alias("blob"), text.alias("text")).groupBy("blob").agg(F.first("text").alias("text"))
    if ledger is not None:
        known = ledger.where(F.col("rule").isin([f"{r}@{v}" for r, v in rules.items()])).groupBy("blob").agg(F.collect_set("rule").alias("done"))
        blobs = blobs.join(known, "blob", "left").where(F.coalesce(F.size("done"), F.lit(0)) < len(rules)).select("blob", "text", "done")
    return blobs.mapInArrow(_scan(rules), _LEDGER)


def update(docs: DataFrame, path: str, rules: dict[str, str] | None = None) -> DataFrame:
    """The whole ledger of the folder `path`, after what it lacks of docs' texts has been scanned and appended.

    A folder that isn't there is an empty ledger. Nothing is appended if all has been seen. A job that is lost before
    it is committed leaves the ledger as it was; the next one scans those blobs again. Two jobs that write at a time
    may scan a blob twice, whose findings are then the same.
    """
    spark = docs.sparkSession
    read = lambda: spark.read.schema(_LEDGER).parquet(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    scan(docs, read() if there else None, rules).write.mode("append").parquet(path)
    return read()


def _found(ledger: DataFrame, rules: dict[str, str]) -> DataFrame:
    """blob and spans, by start and then by the rules' order, of the blobs in which the rules found something."""
    found = ledger.where(F.col("rule").isin([f"{r}@{v}" for r, v in rules.items()]) & (F.size("spans") > 0)).groupBy("blob").agg(F.flatten(F.collect_set("spans")).alias("spans"))
    order = F.create_map(*(x for i, r in enumerate(rules) for x in (F.lit(r), F.lit(i))))
    keyed = F.array_sort(F.array_distinct(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), order[s["kind"]].alias("nth"), s["kind"].alias("kind"), s["end"].alias("end")))))
    return found.select("blob", F.transform(keyed, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("spans"))


def findings(docs: DataFrame, ledger: DataFrame, rules: dict[str, str] | None = None) -> DataFrame:
    """docs' doc_id and blob with spans, those of all rules by start and then by the rules' order; an empty list where there are none."""
    paths = docs.select("doc_id", blob_of(text_of()).alias("blob"))
    both = spread_join(paths, _found(ledger, RULES if rules is None else rules), "blob")
    return both.select("doc_id", "blob", F.coalesce("spans", F.array().cast(_SPANS)).alias("spans"))


def scan_documents(docs: DataFrame, ledger_path: str | None = None) -> DataFrame:
    """findings() of docs after the ledger of the folder `ledger_path` has been brought up to date; without a path, of a new ledger in the shared folder.

    A null text counts as empty and has none; repeated rows are answered each; other columns are ignored.
    """
    return findings(docs, update(docs, ledger_path or scratch_path(docs.sparkSession)))


def joined(spans: Column) -> Column:
    """kind:start:end of the spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _mask(column: str, mark: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches, "text"):
            spans = batch.column(batch.schema.get_field_index(column)).to_pylist()
            out = []
            for text, found in zip(texts, spans, strict=True):
                if found and text is not None:
                    parts, at = [], 0
                    for s in found:  # by start; spans of different rules may overlap
                        if s["end"] > at:
                            if s["start"] >= at:
                                parts += [text[at : s["start"]], mark]
                            at = s["end"]
                    text = "".join([*parts, text[at:]])
                out.append(text)
            columns = [pa.array(out, pa.string()) if n == "text" else batch.column(i) for i, n in enumerate(batch.schema.names) if n != column]
            yield pa.RecordBatch.from_arrays(columns, names=[n for n in batch.schema.names if n != column])

    return run


def mask(docs: DataFrame, mark: str = "[secret]", ledger_path: str | None = None) -> DataFrame:
    """docs with every secret in text replaced by the mark; all rows and columns stay, whatever their names. A null text stays null.

    The ledger decides which texts are touched: rows are matched to findings by the content of their text. It is that
    of the folder `ledger_path`, brought up to date, or a new one in the shared folder.
    """
    on_executors(docs.sparkSession)
    found = _found(update(docs, ledger_path or scratch_path(docs.sparkSession)), RULES)
    key, spans = free_name(docs, "blob"), free_name(docs, "found_spans")
    found = found.select(F.col("blob").alias(key), F.col("spans").alias(spans))
    rows = spread_join(docs.withColumn(key, blob_of(text_of())), found, key).select(*docs.columns, spans)
    return rows.mapInArrow(_mask(spans, mark), docs.schema)
