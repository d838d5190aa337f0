"""One query for each group of operators, and the same in SQL.

The mails are made of orders and customers, by a statement that both engines
understand; their characters are ones that normalisation leaves alone, unless a
query is about normalisation.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ..crf.model import CrfModel
from ..functions import normalize, patterns, text
from ..functions.batches import Lines, line_marks, parts, split
from ..operators import brackets, evaluate, features, flat, lines
from ..schema import RATIOS
from .pipeline import error_text, extract, finder, gate
from .report import by_group
from .training import with_expected_body

#: A mail for each order.
MAILS = """
select o_orderkey as mail_id,
  case when o_orderkey % 5 = 0 then '' when o_orderkey % 5 = 1 then c_name || '様' || chr(10) || chr(10) else '株式会社サンプル' || chr(10) || c_name || '様' || chr(10) end
  || case o_orderkey % 3 when 0 then 'お世話になっております。' when 1 then 'お疲れ様です。' else '突然のご連絡失礼いたします。' end || chr(10) || chr(10)
  || case when o_orderkey % 7 = 0 then '> 前回の注文' || cast(o_orderkey - 1 as string) || 'について' || chr(10) || '>> 納期を教えてください。' || chr(10) else '' end
  || '注文番号' || cast(o_orderkey as string) || 'の件でご連絡いたします。' || chr(10)
  || case when o_orderkey % 4 = 0 then '添付の資料、参考まで。' || chr(10) || chr(10) || '金額は「' || cast(o_custkey as string) || '円」です, 以上の通り です。' || chr(10) else '状態は' || o_orderstatus || 'です。' || chr(10) end
  || case when o_orderkey % 6 = 0 then '2024年1月15日 田中太郎:' || chr(10) || '> ' || o_orderpriority || chr(10) || 'Re: ' || o_orderpriority || chr(10) else '' end
  || case when o_orderkey % 8 = 0 then '=====' || chr(10) || '株式会社サンプル' || chr(10) || 'TEL: 03-1234-5678' || chr(10) || '=====' || chr(10) || '次の例です' || chr(10) else '' end
  || case o_orderkey % 3 when 0 then 'よろしくお願いいたします。' when 1 then '以上' else 'ご返信をお待ちしております。' end
  || case when o_orderkey % 2 = 0 then chr(10) || chr(10) || '----------' || chr(10) || '営業部 課長' || chr(10) || '田中太郎' || chr(10) || 'TEL: 03-' || cast(1000 + o_orderkey % 9000 as string) || '-5678' || chr(10) || 'E-mail: user' || cast(o_custkey as string) || '@example.co.jp' else '' end
  as email_text
from orders join customer on o_custkey = c_custkey
"""

#: Lines and mails that need normalisation; both have a character without width.
RAW_LINE = "case pos % 4 when 0 then 'ーー━━──\ufeff' when 1 then '  -----ー--ーー ' when 2 then '★━━━★' else '\u200b' || text end"
RAW_MAIL = "case mail_id % 5 when 0 then null when 1 then '  ' when 2 then '\u200b' else email_text end"


def _tables(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for name in names:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mails, dealt over all cores: they are made of small files, which a few tasks would read.

    The orders are dealt, which are shorter than the mails, and by their key, which needs no sort.
    """
    _tables(spark, sf_dir, "orders", "customer")
    own = spark.table("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    own.repartition(2 * spark.sparkContext.defaultParallelism, "o_orderkey").createOrReplaceTempView("orders")
    return spark.sql(MAILS)


def mail_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of lines: ``mail_id``, ``pos``, ``text``."""
    return lines.explode_lines(mails(spark, sf_dir).withColumn("lines", text.split_lines(F.col("email_text"))), "lines", "mail_id")


def _in_batches(own: DataFrame, make: Callable[[pa.Array, pa.Array], dict[str, pa.Array]], schema: str, key: str = "mail_id", text: str = "email_text") -> DataFrame:
    """What ``make`` finds in the mails of a batch, given their keys and texts, as rows."""
    kind = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, mail = batch.columns
            for a, b in parts(mail):
                found = make(keys[a:b], mail[a:b])
                yield pa.RecordBatch.from_arrays([found[f.name].cast(f.type) for f in kind], schema=kind)

    return own.select(key, text).mapInArrow(run, schema)


def _over_mails(own: DataFrame, make: Callable[[pa.Array, Lines], dict[str, pa.Array]], schema: str, key: str = "mail_id", text: str = "email_text") -> DataFrame:
    """The same, given the lines."""
    return _in_batches(own, lambda keys, mail: make(keys, split(mail)), schema, key, text)


def _flags(spark: SparkSession, sf_dir: str, *names: str, full: bool = False) -> DataFrame:
    """A row for each line of the mails (with ``full``, for each that is not empty) with its marks."""

    def make(keys: pa.Array, own: Lines) -> dict[str, pa.Array]:
        if full:
            keep = pc.not_equal(own.texts, "").to_numpy(zero_copy_only=False)[own.ids]
            place, own = own.place[keep], own.where(keep)
        else:
            place = own.place
        return {"mail_id": keys.take(pa.array(own.mail)), "pos": pa.array(place)} | {k: pa.array(v[own.ids]) for k, v in line_marks(own.texts, names).items()}

    own = mails(spark, sf_dir)
    kinds = (f"{n} {'double' if n in RATIOS else 'boolean'}" for n in names)
    return _over_mails(own, make, ", ".join([f"mail_id {own.schema['mail_id'].dataType.simpleString()}", "pos int", *kinds]))


_RULED_BY = ("quote_depth", "is_forward_reply_header", "has_contact_info", "has_position_pattern", "has_name_pattern", "is_closing", "is_delimiter", "is_greeting")


def _rule_labels(spark: SparkSession, sf_dir: str, mail: str = "email_text") -> DataFrame:
    """The lines of each mail, and the content lines as arrays: ``labels`` by rule and ``separators``."""
    own = mails(spark, sf_dir).select("mail_id", F.expr(mail).alias("email_text"))

    def make(keys: pa.Array, own: Lines) -> dict[str, pa.Array]:
        content, _ = own.content()
        marks = {k: v[content.ids] for k, v in line_marks(own.texts, _RULED_BY).items()}
        listed = lambda x: pa.ListArray.from_arrays(pa.array(content.offsets, pa.int32()), x)
        return {"mail_id": keys, "lines": own.lists(), "labels": listed(flat.label_names(flat.by_rule(marks))), "separators": listed(pa.array(marks["is_delimiter"]))}

    return _over_mails(own, make, f"mail_id {own.schema['mail_id'].dataType.simpleString()}, lines array<string>, labels array<string>, separators array<boolean>")


def line_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", text.split_lines(text.newlines(F.col("text"))).alias("lines"))
    return lines.explode_lines(docs, "lines", "doc_id").select("doc_id", "pos", F.length("text").alias("n_chars"), text.is_blank(F.col("text")).alias("is_blank"))


def blank_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = mails(spark, sf_dir).withColumn("lines", text.split_lines(F.col("email_text")))
    found = lines.with_gaps(lines.content(F.col("lines")), F.size("lines"))
    mapped = own.withColumn("m", lines.blank_map(F.col("lines")))
    rows = lines.exploded(mapped, found, "mail_id", F.size("m.blank_positions").alias("n_blank"), F.col("m.original_line_count").alias("n_lines"), names=("idx", "c"))
    return rows.select("mail_id", "idx", "c.original_index", "c.blank_lines_before", "c.blank_lines_after", "n_blank", "n_lines")


def newline_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = mails(spark, sf_dir).withColumn("raw", F.expr("case when mail_id % 2 = 0 then replace(email_text, chr(10), chr(13) || chr(10)) else replace(email_text, chr(10), chr(13)) end"))
    return own.select("mail_id", F.size(text.split_lines(text.newlines(F.col("raw")))).alias("n_lines"), (text.newlines(F.col("raw")) == F.col("email_text")).alias("same"))


def delimiter_unify(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = mail_lines(spark, sf_dir).withColumn("raw", F.expr(RAW_LINE))
    return own.select("mail_id", "pos", normalize.unified_lines(F.col("raw")).alias("line"))


def quote_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mail_lines(spark, sf_dir).select("mail_id", "pos", patterns.quote_depth(F.col("text")).alias("depth"), patterns.is_forward_reply_header(F.col("text")).alias("header"))


def quote_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = features.with_features(mails(spark, sf_dir).withColumn("lines", text.split_lines(F.col("email_text"))), names=("quote_depth", "is_forward_reply_header"))
    return own.select("mail_id", "has_quotes", "has_forward_reply", *(F.coalesce(c, F.lit(-1)).alias(c) for c in ("first_quote_index", "last_quote_index")))


def pattern_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flags(spark, sf_dir, "is_greeting", "is_closing", "has_contact_info", "has_company_pattern", "has_position_pattern", "has_meta_discussion", "is_inside_quotation_marks")


def document_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null")
    names = ("has_contact_info", "has_company_pattern", "has_position_pattern", "is_inside_quotation_marks", "is_forward_reply_header")

    def make(keys: pa.Array, own: Lines) -> dict[str, pa.Array]:
        mail, n = own.mail, len(own.sizes)
        return {"doc_id": keys} | {k: pa.array(np.bincount(mail, v[own.ids], n).astype(np.int64)) for k, v in line_marks(own.texts, names).items()}

    found = _over_mails(docs, make, ", ".join([f"doc_id {docs.schema['doc_id'].dataType.simpleString()}", *(f"{n} long" for n in names)]), "doc_id", "text")
    return found.groupBy("doc_id").agg(*(F.sum(n).alias(n) for n in names))


def name_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flags(spark, sf_dir, "has_name_pattern", "has_name").select("mail_id", "pos", F.col("has_name_pattern").alias("is_name"), "has_name")


def separator_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mail_lines(spark, sf_dir).select("mail_id", "pos", patterns.is_separator(F.col("text")).alias("is_separator"))


def char_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flags(spark, sf_dir, *RATIOS, full=True)


def _features(spark: SparkSession, sf_dir: str, *names: str, mail: str = "email_text") -> DataFrame:
    own = features.with_features(mails(spark, sf_dir).withColumn("lines", text.split_lines(F.expr(mail))), names=names)
    return lines.exploded(own, "features", "mail_id", names=("idx", "f")).select("mail_id", "idx", *(F.col("f")[n].alias(n) for n in names))


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("position_normalized", "position_reverse", "lines_from_start", "lines_from_end", "position_rel_first_quote", "position_rel_last_quote", "line_length", "blank_lines_before", "blank_lines_after", "preceded_by_delimiter")
    return _features(spark, sf_dir, *names)


def context_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _features(spark, sf_dir, "context_greeting_count", "context_closing_count", "context_contact_count", "context_quote_count", "context_separator_count")


#: Some mails get separators that are one or two characters longer than the one they may belong to, and more of them.
SEPARATED = "replace(replace(email_text, chr(10) || '次の例です', case mail_id % 3 when 0 then '=' || chr(10) || '次の例です' when 1 then '==' || chr(10) || '次の例です' || chr(10) || '======' else chr(10) || '次の例です' end), '営業部', '---------' || chr(10) || '営業部')"


def bracket_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _features(spark, sf_dir, "in_bracketed_section", "bracket_has_signature_patterns", mail=SEPARATED)


def fix_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _rule_labels(spark, sf_dir).withColumn("fixed", brackets.repaired_native(F.col("labels"), F.col("separators")))
    return lines.exploded(own, "fixed", "mail_id", names=("idx", "label"))


def unify_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _rule_labels(spark, sf_dir, SEPARATED).withColumn("one", brackets.unified_blocks(F.col("labels"), F.col("separators")))
    return own.select("mail_id", F.array_join("one", ",").alias("labels"))


def _carried(own: Lines) -> tuple[pa.Array, np.ndarray]:
    """The label by rule of each line, blank ones too, and whether it is blank."""
    content, at = own.content()
    marks = {k: v[content.ids] for k, v in line_marks(own.texts, _RULED_BY).items()}
    row, blank = flat.carried(own, at, content)
    return flat.label_names(flat.by_rule(marks)).take(pa.array(row, mask=row < 0)), blank


def reconstruct(spark: SparkSession, sf_dir: str) -> DataFrame:
    def make(keys: pa.Array, own: Lines) -> dict[str, pa.Array]:
        labels, blank = _carried(own)
        return {"mail_id": keys.take(pa.array(own.mail)), "pos": pa.array(own.place), "is_blank": pa.array(blank), "label": labels, "confidence": pa.array(np.full(len(blank), 0.5), mask=blank)}

    own = mails(spark, sf_dir)
    return _over_mails(own, make, f"mail_id {own.schema['mail_id'].dataType.simpleString()}, pos int, is_blank boolean, label string, confidence double")


def assemble_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    def make(keys: pa.Array, own: Lines) -> dict[str, pa.Array]:
        content, at = own.content()
        marks = {k: v[content.ids] for k, v in line_marks(own.texts, _RULED_BY).items()}
        # a delimiter that is nothing else is no closing here
        other = marks["is_delimiter"] & ~marks["is_closing"] & (flat.by_rule(marks) == flat.CODE["CLOSING"])
        codes = np.where(other, np.where(marks["is_greeting"], flat.CODE["GREETING"], flat.CODE["OTHER"]), flat.by_rule(marks))
        body, signature, quotes = flat.bodies(own, at, content, flat.label_names(codes))
        text = pc.fill_null(body, "")
        return {"mail_id": keys, "body_text": text, "signature_index": pa.array(signature), "inline_quote_count": pa.array(quotes), "success": pc.not_equal(text, "")}

    own = mails(spark, sf_dir)
    return _over_mails(own, make, f"mail_id {own.schema['mail_id'].dataType.simpleString()}, body_text string, signature_index int, inline_quote_count long, success boolean")


def extract_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = mails(spark, sf_dir).select("mail_id", F.expr(RAW_MAIL).alias("t"), F.expr("(mail_id % 10) / 10.0").cast("double").alias("confidence"))
    kept = normalize.trimmed(F.transform(text.split_lines(F.coalesce("t", F.lit(""))), lambda x: text.strip(normalize.without_zero_width(x))))
    e = gate(F.col("t"), kept, F.col("mail_id") % 7 != 0, F.col("confidence"), 0.5)
    return own.withColumn("e", e).select("mail_id", F.col("e.type").alias("error_type"), error_text(F.col("e")).alias("error_text"), F.col("e").isNull().alias("success"))


def extract_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(mails(spark, sf_dir), CrfModel.load(), keep_prediction=True)
    return out.select("mail_id", "body", F.round("confidence", 6).alias("confidence"), "success", F.col("error.type").alias("error_type"), F.array_join("prediction.labels", ",").alias("labels"), "signature_detected", "inline_quotes_included")


def extract_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The extraction over long texts that are no mails."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("text").alias("email_text"))
    out = extract(docs, CrfModel.load(), keep_prediction=True)
    return out.select("doc_id", F.length("body").alias("n_chars"), F.round("confidence", 6).alias("confidence"), "success", F.col("error.type").alias("error_type"), F.size("prediction.labels").alias("n_lines"))


def crf_marginals(spark: SparkSession, sf_dir: str) -> DataFrame:
    find = finder(CrfModel.load())

    def make(keys: pa.Array, mail: pa.Array) -> dict[str, pa.Array]:
        prediction = find(mail).field("prediction")
        labels = prediction.field("labels")
        offsets = labels.offsets.to_numpy().astype(np.int64)
        places = Lines(offsets, np.zeros(offsets[-1], np.int32), pa.array([], pa.string()))
        p = prediction.field("marginals").flatten().flatten().to_numpy().reshape(-1, len(evaluate.LABELS))
        known = {f"p_{y.lower()}": pa.array(flat.rounded(p[:, k])) for k, y in enumerate(evaluate.LABELS)}
        return {"mail_id": keys.take(pa.array(places.mail)), "idx": pa.array(places.place), "label": labels.flatten(), "confidence": pa.array(flat.rounded(prediction.field("confidences").flatten().to_numpy()))} | known

    own = mails(spark, sf_dir)
    kinds = (f"p_{y.lower()} double" for y in evaluate.LABELS)
    return _in_batches(own, make, ", ".join([f"mail_id {own.schema['mail_id'].dataType.simpleString()}", "idx int", "label string", "confidence double", *kinds]))


def japanese_normalization(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("ｶﾞｲﾄﾞ　ＡＢＣ　すごーーーい〜 "), F.col("email_text"))
    own = mails(spark, sf_dir).withColumn("all", normalize.normalized_lines(raw))
    return own.select("mail_id", F.array_join(normalize.trimmed(F.col("all")), "\n").alias("normalized"))


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as expected and, changed in known ways, as extracted bodies."""
    _tables(spark, sf_dir, "documents", "labels")
    return spark.sql(_JUDGED).withColumn("error", F.struct(F.col("error_type").alias("type"))).drop("error_type")


_JUDGED = """
select d.doc_id, lang, coalesce(d.text, '') as expected_body,
  case when d.doc_id % 5 = 0 then null when d.doc_id % 5 = 1 then '  ' || d.text || chr(10) when d.doc_id % 5 = 2 then substr(d.text, 1, cast(length(d.text) - length(d.text) % 100 as int)) when d.doc_id % 5 = 3 then replace(d.text, chr(10), chr(10) || chr(10)) else substr(d.text, 1, 10) end as body,
  coalesce(quality, 1) = 1 as success, cast(d.doc_id % 97 as double) / 97 as confidence,
  case when d.doc_id % 2 = 0 then 'LowConfidenceError' else 'NoBodyDetectedError' end as error_type
from documents d left join labels l on d.doc_id = l.doc_id
"""


def eval_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.outcomes(_judged(spark, sf_dir)).select("doc_id", "exact_match", "content_match", "acceptable", "confident_wrong", "failed_static", "error_type")


def eval_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.rates(evaluate.outcomes(_judged(spark, sf_dir)), "lang")


def eval_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.counts_by(evaluate.outcomes(_judged(spark, sf_dir)).where("failed_static"), "error_type")


def eval_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_group(evaluate.outcomes(_judged(spark, sf_dir)), "lang")


def eval_confidence_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluate.confidence_stats(_judged(spark, sf_dir).withColumn("confidence", F.round("confidence", 6)))
    return out.select("n", F.round("mean", 6).alias("mean"), "min", "max", "median", "p10", "p90")


def eval_label_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _rule_labels(spark, sf_dir).select(F.col("labels").alias("truth"), brackets.repaired_native(F.col("labels"), F.col("separators")).alias("predicted"))
    return evaluate.label_metrics(own)


def confident_wrong(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.confident_wrong(_judged(spark, sf_dir)).select("doc_id", "confidence")


def label_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.label_distribution(lines.exploded(_rule_labels(spark, sf_dir), "labels", names=("idx", "label")))


def label_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = lines.exploded(_rule_labels(spark, sf_dir), evaluate.aligned(F.slice(F.col("labels"), 1, 4), F.col("labels")), "mail_id", names=("idx", "a"))
    return own.groupBy("a.predicted", "a.truth", "a.differs").agg(F.count("*").alias("n"))


def find_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = mails(spark, sf_dir).withColumn("lines", text.split_lines(F.col("email_text")))
    return own.select("mail_id", evaluate.first_line_with(F.filter("lines", lambda x: x != ""), "です").alias("idx"))


def gold_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The body that labelled lines stand for; the same as assembling them, so both have the same SQL."""

    def make(keys: pa.Array, own: Lines) -> dict[str, pa.Array]:
        rows = pa.StructArray.from_arrays([own.texts.take(pa.array(own.ids)), _carried(own)[0]], names=["text", "label"])
        return {"mail_id": keys, "lines_gold": pa.ListArray.from_arrays(pa.array(own.offsets, pa.int32()), rows)}

    own = mails(spark, sf_dir)
    gold = _over_mails(own, make, f"mail_id {own.schema['mail_id'].dataType.simpleString()}, lines_gold array<struct<text:string,label:string>>")
    return with_expected_body(gold).select("mail_id", F.length(F.replace("expected_body", F.lit(" "))).alias("n_chars"), F.size(F.split("expected_body", "\n")).alias("n_lines"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        line_split, blank_map, newline_norm, delimiter_unify, quote_depth, quote_span, pattern_flags, document_flags, name_lines, separator_lines, char_ratios, positions, context_counts, bracket_sections,
        fix_transitions, unify_blocks, reconstruct, assemble_body, extract_gate, extract_full, extract_documents, crf_marginals, japanese_normalization,
        eval_outcomes, eval_rates, eval_errors, eval_by_group, eval_confidence_stats, eval_label_metrics, confident_wrong, label_distribution, label_alignment, find_line, gold_bodies,
    )
}
