"""Template rendering and document assembly (OP-47, OP-60..65, OP-07 row prep).

A template is compiled once on the driver into literal and field parts; the
fill itself is one ``concat`` column expression, so rendering runs inside
whole-stage codegen on the executors. Documents are assembled per batch with
an ordered ``listagg``; a group never holds more than ``batch_size`` rows.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..schemas import PAGE_BREAK
from .numbering import BUCKET, with_batch_id

_FIELD_RE = re.compile(r"\{\{\s*([A-Za-z_][A-Za-z0-9_]*)\s*\}\}")


@dataclass(frozen=True)
class Part:
    text: str
    is_field: bool


@dataclass(frozen=True)
class Template:
    lines: tuple[tuple[Part, ...], ...]

    @property
    def fields(self) -> list[str]:
        seen: list[str] = []
        for line in self.lines:
            for p in line:
                if p.is_field and p.text not in seen:
                    seen.append(p.text)
        return seen


def compile_template(text: str) -> Template:
    """OP-61: split ``{{ Field }}`` placeholders from literal text, line by line."""
    lines = []
    for raw in text.split("\n"):
        parts: list[Part] = []
        pos = 0
        for m in _FIELD_RE.finditer(raw):
            if m.start() > pos:
                parts.append(Part(raw[pos:m.start()], False))
            parts.append(Part(m.group(1), True))
            pos = m.end()
        if pos < len(raw) or not parts:
            parts.append(Part(raw[pos:], False))
        lines.append(tuple(parts))
    return Template(tuple(lines))


def _field_value(name: str, columns: Sequence[str]) -> Column:
    # N12: NULL and unknown placeholders render as ''. Form feeds are removed so
    # a value cannot fake a page break in the assembled batch.
    if name not in columns:
        return F.lit("")
    return tx.no_page_break(tx.empty_if_null(F.col(f"`{name}`")))


def render_column(template: Template | str, columns: Sequence[str],
                  suppress_blank_lines: bool = False) -> Column:
    """OP-60 / OP-62: the filled template as a column expression.

    With ``suppress_blank_lines`` a line made only of fields (and blanks) is
    dropped when all its fields are empty; lines with other text always stay.
    """
    tpl = compile_template(template) if isinstance(template, str) else template
    line_exprs: list[Column] = []
    for line in tpl.lines:
        pieces = [_field_value(p.text, columns) if p.is_field else F.lit(p.text) for p in line]
        expr = F.concat(*pieces) if len(pieces) > 1 else pieces[0]
        fields = [p for p in line if p.is_field]
        only_fields = fields and all(p.text.strip() == "" for p in line if not p.is_field)
        if suppress_blank_lines and only_fields:
            any_value = None
            for p in fields:
                filled = _field_value(p.text, columns) != F.lit("")
                any_value = filled if any_value is None else (any_value | filled)
            expr = F.when(any_value, expr)
        line_exprs.append(expr)
    # concat_ws skips NULL lines, which is exactly "suppress this line".
    return F.concat_ws("\n", *line_exprs)


def render_documents(df: DataFrame, template: Template | str, out: str = "doc",
                     suppress_blank_lines: bool = False, keep: Sequence[str] | None = None) -> DataFrame:
    """OP-60 + OP-15: fill the template from every column of each row."""
    doc = render_column(template, df.columns, suppress_blank_lines).alias(out)
    return df.select(*(keep if keep is not None else df.columns), doc)


def failure_flags(df: DataFrame, template: Template | str, required: Sequence[str] | None = None,
                  flag: str = "render_failed") -> DataFrame:
    """Mark rows that cannot be rendered: a required field (default: every
    field the template uses that the row has) is NULL or blank. Adds the
    boolean ``flag`` and ``reason`` (missing field names, '' when fine)."""
    tpl = compile_template(template) if isinstance(template, str) else template
    req = [c for c in (required if required is not None else tpl.fields) if c in df.columns]
    flags = [(c, tx.is_missing(F.col(f"`{c}`"))) for c in req]
    bad = F.lit(False)
    for _, f in flags:
        bad = bad | f
    names = tx.join_names(flags) if flags else F.lit("")
    return df.withColumn(flag, bad).withColumn(
        "reason", F.when(F.col(flag), F.concat(F.lit("missing: "), names)).otherwise(F.lit("")))


def quarantine_failures(df: DataFrame, template: Template | str,
                        required: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """OP-64: split rows that cannot be rendered from those that can.

    Returns ``(ok, quarantined)``; the quarantined rows carry ``reason``
    listing the missing fields. See :func:`failure_flags`.
    """
    tagged = failure_flags(df, template, required, "__bad")
    ok = tagged.filter(~F.col("__bad")).drop("__bad", "reason")
    quarantined = tagged.filter(F.col("__bad")).drop("__bad")
    return ok, quarantined


def ordered_collect(df: DataFrame, group: str, order: str, value: str, sep: str, out: str = "text") -> DataFrame:
    """OP-47: values joined in ``order`` inside each group, whichever task ran first."""
    return df.groupBy(group).agg(
        F.expr(f"listagg(`{value}`, {_sql_str(sep)}) WITHIN GROUP (ORDER BY `{order}`)").alias(out))


def _sql_str(s: str) -> str:
    if s == PAGE_BREAK:
        return "chr(12)"
    if s == "\n":
        return "chr(10)"
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def assemble_batches(docs: DataFrame, batch_size: int, rn: str = "rn", doc: str = "doc") -> DataFrame:
    """OP-63: documents joined in record order per batch, page break between records.

    Output: ``batch_id, first_record, last_record, n_docs, text``. Batches in
    ``batch_id`` order form the whole run; each group is bounded by
    ``batch_size``, so no task ever holds the whole output.

    Documents that still carry the numbering's ``BUCKET`` columns lie bucket
    by bucket in partitions. Batches that fit into one bucket are then
    assembled in place; only the documents of the two batches at a bucket's
    ends are shuffled.
    """
    b = with_batch_id(docs, batch_size, rn)
    joined = (F.min(rn).alias("first_record"), F.max(rn).alias("last_record"), F.count(F.lit(1)).alias("n_docs"),
              F.expr(f"listagg(`{doc}`, chr(12)) WITHIN GROUP (ORDER BY `{rn}`)").alias("text"))
    if not set(BUCKET) <= set(docs.columns):
        return b.groupBy("batch_id").agg(*joined)
    bucket, first, last, total = (F.col(c) for c in BUCKET)
    whole = (F.col("batch_id") * batch_size + 1 >= first) & (
        F.least((F.col("batch_id") + 1) * batch_size, total) <= last)
    inside = b.filter(whole).groupBy(bucket, "batch_id").agg(*joined).drop(BUCKET[0])
    edges = b.filter(~whole).groupBy("batch_id").agg(*joined)
    return inside.unionByName(edges)


def render_single_range(docs: DataFrame, part_size: int, rn: str = "rn", doc: str = "doc") -> DataFrame:
    """OP-65: the whole selection as one range 1..N (no batching).

    The range is one logical document; it is stored as ordered parts of at
    most ``part_size`` documents so no single task has to hold all of it.
    Joining the parts' text in ``part_no`` order with a page break gives the
    single-range document.
    """
    parts = assemble_batches(docs, part_size, rn, doc).withColumnRenamed("batch_id", "part_no")
    return parts.select(F.lit(0).cast("bigint").alias("range_id"), "part_no", "first_record",
                        "last_record", "n_docs", "text")


def per_record_documents(docs: DataFrame, serial: str | None, order: str, doc: str = "doc",
                         row_pos: str | None = None, file: str | None = None) -> DataFrame:
    """OP-07 (row prep): one document per record, named by its serial prefix.

    Records sharing a name overwrite each other, so the last one in ``order``
    wins. ``max_by`` is a map-side-combinable aggregate, so a name shared by
    many rows does not pile into one task. Without a serial column the name
    is ``row{n}`` where ``n`` is the 1-based data row: the sheet line in
    ``row_pos`` (header on line 1) minus one. For sheets in several files
    ``file`` names the path column: files follow each other in path order, and
    names without a serial get the file's MD5 so that none is lost.
    """
    if serial is not None:
        name = tx.serial_prefix(serial)
    else:
        name = F.concat(F.lit("row"), (F.col(row_pos) - F.lit(1)).cast("string"))
        if file is not None:
            name = F.concat(name, F.lit("_"), F.md5(F.col(file)))
    place = F.col(order) if file is None else F.struct(file, order)
    return (docs.withColumn("doc_name", name)
                .groupBy("doc_name")
                .agg(F.max_by(F.col(doc), place).alias("doc_text")))
