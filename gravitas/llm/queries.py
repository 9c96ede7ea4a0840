"""One query per operator over its whole table, and SQL that must give the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gravitas.llm import anchors, bpe, langid, licenses, neardup, periodic, phrases, quality_model, quality_rules, runindex, sqlbpe, superkmer, warc, winnow

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def digest(column: str) -> Column:
    return F.sha2(F.col(column).cast("binary"), 256)


def encoded(docs: DataFrame) -> DataFrame:
    return bpe.encode_documents(docs.select("doc_id", "text")).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " ").cast("binary"), 256).alias("ids_sha256"),
        digest("decoded").alias("decoded_sha256"),
    )


@query("op8_bpe")
def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"))


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def decontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The columns that the contract of op5 names."""
    ids = F.array_sort(F.col("items").cast("array<string>"))
    return winnow.contamination(docs, items).select(
        "doc_id",
        "n_words",
        winnow.covered("spans").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", ids).cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


@query(
    "op5_decontaminate",
    f"""
with d as (select doc_id, coalesce({_WORDS}, []) as w from documents),
b as (select item_id, {_WORDS} as w from benchmark where text is not null),
bw as (
    select distinct item_id, s, array_to_string(w[i + 1 : i + s], ' ') as t
    from (select item_id, w, least(len(w), 10) as s, unnest(range(0, len(w) - least(len(w), 10) + 1)) as i from b where len(w) > 0)
),
dw as (
    select doc_id, s, i, array_to_string(w[i + 1 : i + s], ' ') as t
    from (select doc_id, w, s, unnest(range(0, greatest(len(w) - s + 1, 0))) as i from d, (select distinct s from bw))
),
hits as (select dw.doc_id, dw.i, dw.s, bw.item_id from dw join bw using (s, t)),
places as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + s)) as p from (select distinct doc_id, i, s from hits)) group by doc_id),
found as (select doc_id, count(*) as n_items, string_agg(id, ',' order by id) as ids from (select distinct doc_id, cast(item_id as varchar) as id from hits) group by doc_id)
select d.doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
    sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join places using (doc_id) left join found using (doc_id)
""",
)
def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op6_run_index")
def op6_run_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = runindex.kept_bytes(anchors.with_spans(docs, runindex.repeated_bytes(docs)))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query(
    "op10_super_kmer",
    r"""
with d as (select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
g as (
    select doc_id, i, sha256(array_to_string(w[i + 1 : i + 35], ' ')) as t
    from (select doc_id, w, unnest(range(0, greatest(len(w) - 34, 0))) as i from d)
),
again as (select t from g group by t having count(*) > 1),
hit as (select distinct doc_id, p from (select doc_id, unnest(range(i, i + 35)) as p from g semi join again using (t))),
each as (select doc_id, unnest(w) as x, unnest(range(0, len(w))) as p from d),
kept as (select doc_id, count(*) as n, string_agg(x, ' ' order by p) as t from each anti join hit using (doc_id, p) group by doc_id)
select d.doc_id, len(w) as n_words, len(w) - coalesce(n, 0) as n_removed, sha256(coalesce(t, '')) as kept_sha256
from d left join kept using (doc_id)
""",
)
def op10_super_kmer(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = superkmer.kept_words(anchors.with_spans(docs, superkmer.repeated_words(docs)))
    return kept.select("doc_id", "n_words", "n_removed", digest("kept").alias("kept_sha256"))


@query("op7_near_duplicates")
def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), similarity=neardup.Similarity(words=3, percent=85))


@query(
    "op1_quality_rules",
    r"""
with base as (
    select doc_id, lang, source, coalesce(text, '') as text,
        list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l
    from documents
),
grams as (select doc_id, i, array_to_string(w[i + 1 : i + 3], ' ') as g from (select doc_id, w, unnest(range(0, greatest(len(w) - 2, 0))) as i from base)),
again as (select doc_id, g from grams group by doc_id, g having count(*) > 1),
repeats as (
    select doc_id, count(distinct p) as n
    from (select doc_id, unnest(range(i, i + 3)) as p from grams semi join again using (doc_id, g)) group by doc_id
),
m as (
    select doc_id, lang, source, len(w) as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as word_chars,
        len(regexp_extract_all(text, '[#*$%&|<>]')) as n_symbols, len(l) as n_lines, len(l) - len(list_distinct(l)) as n_dup_lines, coalesce(n, 0) as n_repeat_words
    from base left join repeats using (doc_id)
),
v as (
    select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, 1000 * word_chars // n_words as word_length,
        1000 * n_symbols // n_words as symbols, 1000 * n_dup_lines // n_lines as dup_lines, 1000 * n_repeat_words // n_words as repeat_words
    from m
),
u as (
    select lang, source, measure, value - value % cast(pow(2, greatest(length(bin(value)) - 10, 0)) as bigint) as bucket
    from (select * from v where not base_failed) unpivot (value for measure in (word_length, symbols, dup_lines, repeat_words))
),
s as (select lang, source, measure, bucket, count(*) as n from u group by all),
s_own as (select *, sum(n) over (partition by lang, source, measure order by bucket) as upto, sum(n) over (partition by lang, source, measure) as docs from s),
own as (select lang, source, measure, any_value(docs) as docs, min(bucket) filter (4 * upto >= docs) as q1, min(bucket) filter (2 * upto >= docs) as q2 from s_own group by all),
s_lang as (select lang, measure, bucket, sum(n) as n from s group by all),
t_lang as (select *, sum(n) over (partition by lang, measure order by bucket) as upto, sum(n) over (partition by lang, measure) as docs from s_lang),
of_lang as (select lang, measure, any_value(docs) as docs, min(bucket) filter (4 * upto >= docs) as q1, min(bucket) filter (2 * upto >= docs) as q2 from t_lang group by all),
s_all as (select measure, bucket, sum(n) as n from s group by all),
t_all as (select *, sum(n) over (partition by measure order by bucket) as upto, sum(n) over (partition by measure) as docs from s_all),
of_all as (select measure, min(bucket) filter (4 * upto >= docs) as q1, min(bucket) filter (2 * upto >= docs) as q2 from t_all group by all),
q as (
    select o.lang, o.source, o.measure, case when o.docs >= 200 then o.q1 when l.docs >= 200 then l.q1 else a.q1 end as q1,
        case when o.docs >= 200 then o.q2 when l.docs >= 200 then l.q2 else a.q2 end as q2
    from own o join of_lang l on o.measure = l.measure and o.lang is not distinct from l.lang join of_all a on a.measure = o.measure
),
cut as (
    select lang, source, measure, q2 as mid,
        12 * greatest(q2 - q1, case measure when 'word_length' then 100 when 'symbols' then 10 when 'dup_lines' then 45 else 35 end) as reach
    from q
),
long as (select doc_id, lang, source, measure, value from (select * from v where not base_failed) unpivot (value for measure in (word_length, symbols, dup_lines, repeat_words))),
bad as (
    select distinct doc_id from long join cut on long.measure = cut.measure and long.lang is not distinct from cut.lang and long.source is not distinct from cut.source
    where value > mid + reach or (long.measure = 'word_length' and value < mid - reach)
)
select v.doc_id, n_words, cast(word_chars as bigint) as word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    not base_failed and bad.doc_id is null as kept
from v left join bad using (doc_id)
""",
)
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.apply_rules(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _license_oracle() -> str:
    """The rules as literal rows, and the same cutting and matching in SQL."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({quoted(n)}, {quoted(lic)}, {quoted(chr(10).join(s)).replace(chr(10), chr(39) + ' || chr(10) || ' + chr(39))})" for n, (lic, s) in licenses.RULES.items())
    cut = r"list_filter(list_transform(string_split_regex({}, '[.!?;:]+\s+|\s*\n\s*'), lambda s: trim(regexp_replace(translate(s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g'))), lambda s: s <> '')"
    return f"""
with rules(rule, license, text) as (values {rows}),
r as (select rule, license, {cut.format("text")} as s from rules),
known as (select distinct unnest(s) as sentence from r),
d as (select doc_id, {cut.format("coalesce(text, '')")} as s from documents),
f as (select doc_id, no, sentence, row_number() over (partition by doc_id order by no) as k from (select doc_id, unnest(range(1, len(s) + 1)) as no, unnest(s) as sentence from d) semi join known using (sentence)),
seq as (select doc_id, list(sentence order by k) as s, list(no order by k) as nos from f group by doc_id),
hits as (
    select distinct doc_id, license, rule, seq.nos[k] as no
    from (select *, unnest(range(1, len(s) + 1)) as k from seq) seq join r on r.s = seq.s[k : k + len(r.s) - 1]
)
select d.doc_id, len(d.s) as n_sentences, coalesce(len(seq.s), 0) as n_known,
    coalesce(h.licenses, '') as licenses, coalesce(h.rules, '') as rules
from d left join seq using (doc_id)
left join (select doc_id, string_agg(license, ',' order by license, rule, no) as licenses, string_agg(rule || '@' || no, ',' order by license, rule, no) as rules from hits group by doc_id) h using (doc_id)
"""


@query("op2_licenses", _license_oracle())
def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_sentences",
        "n_known",
        F.array_join(F.transform("matches", lambda m: m["license"]), ",").alias("licenses"),
        F.array_join(F.transform("matches", lambda m: F.concat(m["rule"], F.lit("@"), m["no"].cast("string"))), ",").alias("rules"),
    )


WARC_DATE = "2024-01-01T00:00:00Z"

_UUID = "'<urn:uuid:' || {0}[1:8] || '-' || {0}[9:12] || '-' || {0}[13:16] || '-' || {0}[17:20] || '-' || {0}[21:32] || '>'"
_TEXT = "html"
for _pattern in (r"(?s)<!--.*?-->", *(rf"(?is)<{_n}\b.*?</{_n}\s*>" for _n in ("script", "style", "head", "nav"))):
    _TEXT = f"regexp_replace({_TEXT}, '{_pattern}', ' ', 'g')"
_TEXT = rf"regexp_replace(translate({_TEXT}, chr(13) || chr(10) || chr(9), '   '), '(?i)<(br|/p|/div|/li|/h[1-6]|/tr|/ul|/table|/article|/section)\b[^>]*>', chr(10), 'g')"
_TEXT = f"regexp_replace({_TEXT}, '(?s)<[^>]*>', ' ', 'g')"
for _name, _plain in warc.ENTITIES:
    _TEXT = f"replace({_TEXT}, '{_name}', {_plain!r})" if _plain != "'" else f"replace({_TEXT}, '{_name}', chr(39))"
_TEXT = rf"regexp_replace(regexp_replace(regexp_replace({_TEXT}, ' +', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g')"


@query(
    "op9_warc",
    f"""
with p as (select page_id, coalesce(url, '') as url, coalesce(html, '') as html from pages),
r as (select *, sha256('response' || chr(10) || coalesce(cast(page_id as varchar), '') || chr(10) || url || chr(10) || html) as h, sha256(html) as sd, {_TEXT} as text from p),
i as (select *, {_UUID.format("h")} as rid from r),
j as (select *, sha256('conversion' || chr(10) || rid) as ch, sha256('metadata' || chr(10) || rid) as mh, sha256(text) as td from i),
k as (
    select *, {_UUID.format("ch")} as cid, {_UUID.format("mh")} as mid, chr(13) || chr(10) as nl from j
),
m as (
    select *, 'source-payload-digest: sha256:' || sd || nl || 'source-payload-length: ' || strlen(html) || nl || 'conversion-record: ' || cid || nl
        || 'conversion-digest: sha256:' || td || nl || nl || 'HTTP/1.1 200 OK' || nl || 'Content-Type: text/html; charset=utf-8' || nl || 'Content-Length: ' || strlen(html) || nl as meta
    from k
)
select page_id, 'metadata' as type, mid as record_id, rid as refers_to, url as target_uri, '{WARC_DATE}' as date, 'application/warc-fields' as content_type,
    strlen(meta) as n_bytes, 'sha256:' || sha256(meta) as block_digest, 'sha256:' || sd as source_digest from m
union all
select page_id, 'conversion', cid, rid, url, '{WARC_DATE}', 'text/plain', strlen(text), 'sha256:' || td, 'sha256:' || sd from m
""",
)
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.derivatives(warc.responses(table(spark, sf_dir, "pages"), WARC_DATE))
    return records.select(F.col("source_id").alias("page_id"), "type", "record_id", "refers_to", "target_uri", "date", "content_type", F.octet_length("block").cast("long").alias("n_bytes"), "block_digest", "source_digest")


def remainder(column: str, n: int) -> Column:
    """crc32 of an id as text, modulo n: which documents a model may learn from."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


ACCEPTED = 0.7


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents with their score, learnt from labels outside the held-out part."""
    return quality_model.score_quality(docs, labels.where(remainder("doc_id", 4) != 2))


@query("op3_quality_model")
def op3_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_scores(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= ACCEPTED).cast("int").alias("predicted"))


@query("op4_language")
def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    learn = docs.where((remainder("doc_id", 3) != 1) & F.col("lang").isNotNull())
    found = langid.identify(docs.select("doc_id", "text"), learn)
    return found.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


@query("op11_sql_bpe")
def op11_sql_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = sqlbpe.encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n_tokens = F.expr("cast(octet_length(ids) div 4 as bigint)")
    return done.select("doc_id", n_tokens.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def with_periods(docs: DataFrame) -> DataFrame:
    """The input that op12's contract fixes: in one document of ten the words from some place on repeat themselves."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    at = docs.select("doc_id", "text", (h % 10 == 0).alias("chosen"), g.alias("g"), F.when(h % 10 == 0, words).alias("w")).withColumn("n", F.size("w"))
    at = at.withColumn("a", F.expr("g % nullif(n, 0)")).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    moved = F.transform("w", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("w", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    return at.select("doc_id", F.when(F.col("chosen") & (F.col("n") > 0), F.array_join(moved, " ")).otherwise(F.col("text")).alias("text"))


@query("op12_periodic_runs")
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(with_periods(table(spark, sf_dir, "documents").select("doc_id", "text")))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    top = found.withColumn("top", longest)
    return top.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("top.start")).alias("start"),
        F.col("top.length").alias("length"),
        (-F.col("top.period")).alias("period"),
        F.expr("1000 * top.length div -top.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "").cast("binary"), 256).alias("runs_sha256"),
        digest("collapsed").alias("collapsed_sha256"),
    )


@query(
    "op13_phrases",
    r"""
with d as (select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
p as (select lang, list_filter(string_split_regex(part, '[\x20\x09]+'), lambda x: x <> '') as w from (select lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) as part from d)),
g as (select lang, s as size, array_to_string(w[i : i + s - 1], ' ') as phrase from (select lang, w, s, unnest(range(1, len(w) - s + 2)) as i from p, (values (1), (2), (3), (4)) sizes(s) where len(w) >= s)),
f as materialized (select lang, size, phrase, count(*) as n from g group by all),
total as (select lang, sum(n) as n from f where size = 1 group by lang),
c as materialized (select lang, size, phrase, n as a, string_split(phrase, ' ') as w from f where size >= 2 and n >= 30),
cuts as (select lang, phrase, a, k, lang || chr(10) || array_to_string(w[1 : k], ' ') as x, lang || chr(10) || array_to_string(w[k + 1 :], ' ') as y from (select *, unnest(range(1, size)) as k from c)),
part as materialized (select lang || chr(10) || phrase as key, n from f where n >= 30),
s as (
    select cuts.lang, phrase, a, k, left_.n as l, right_.n as r, cast(2000000 as hugeint) * a // (left_.n + right_.n) as score
    from cuts join part left_ on left_.key = x join part right_ on right_.key = y
),
weakest as (select * from s qualify row_number() over (partition by lang, phrase order by score, k) = 1),
inner_ as (
    select lang, array_to_string(w[i : i + n - 1], ' ') as phrase, max(a) as longer
    from (select lang, w, a, n, unnest(range(1, size - n + 2)) as i from c, (values (2), (3)) sizes(n) where n < size) group by all
),
kept as (select weakest.* from weakest left join inner_ using (lang, phrase) where longer is null or cast(100 as hugeint) * longer < cast(80 as hugeint) * a)
select lang, rank, phrase, a, l, r, cast(total.n as bigint) as n, cast(score as bigint) as score
from (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept) join total using (lang)
where rank <= 2000
""",
)
def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine_phrases(table(spark, sf_dir, "documents"))
