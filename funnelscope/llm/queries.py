"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from funnelscope.llm import ann, bpe, html_text, lines, mixing, near_dup, phrases, pii, quality, repeats, runs, simhash, toxicity
from funnelscope.llm.labelled import remainder

RANK_FILE = "byte_bpe_multi_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    text = F.col("main_text.text")
    return html_text.main_text(table(spark, sf_dir, "pages")).select(
        "page_id", "url", text.alias("text"), F.char_length(text).cast("long").alias("n_chars"), F.col("main_text.path").alias("path"))


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every text."""
    spans = F.col("personal_spans")
    return pii.find(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", *[pii.count_of(spans, k).alias(f"n_{k}") for k in pii.BASE_KINDS],
        F.sha2(pii.listed(spans, pii.BASE_KINDS), 256).alias("base_sha256"), pii.listed(spans).alias("spans"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of near copies of every text: three-word shingles, similarity of 0.85 or more."""
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), k=3, similar=(85, 100))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are."""
    return simhash.edited_fingerprints(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_chars", "edited_sha256", simhash.as_hex(F.col("fingerprint")).alias("fingerprint"),
        simhash.as_hex(F.col("edited_fingerprint")).alias("edited_fingerprint"), "near_edited", "near_next")


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text without the words of passages of 35 words or more that stand anywhere else."""
    cut = repeats.without_repeats(table(spark, sf_dir, "documents"), window=35)
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every text; learned from the label rows whose remainder by 3 is not 1."""
    documents, held_out = table(spark, sf_dir, "documents").select("doc_id", "text"), remainder("doc_id", 3) == 1
    judge = toxicity.learned(documents, table(spark, sf_dir, "labels"), "toxic", ~held_out)
    score = F.col("toxicity_score")
    return toxicity.score_texts(documents, judge).select(
        "doc_id", held_out.alias("held_out"), score.alias("score"), (score >= 0.7).cast("int").alias("predicted"))


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest rows of every row whose id is divisible by 50."""
    vectors = table(spark, sf_dir, "embeddings")
    found = ann.index(vectors, k=5)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return ann.search(found, F.col("vec_id") % 50 == 0)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as often as its source's rate draws it, in global random order."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"), numbered=True)
    return mixed.select("doc_id", "source", "text", "copy", "mix_position")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded with the public rank file, and its ids decoded again."""
    path = public_tokenizers.path(RANK_FILE)
    encoded = bpe.encode_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), path, public_tokenizers.PATTERN)
    return bpe.decode_ids(encoded.drop("text"), path).select(
        "doc_id", bpe.n_ids(F.col("token_ids")).alias("n_tokens"), F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every text; learned from label rows whose remainder by 5 is not 0."""
    documents, held_out = table(spark, sf_dir, "documents").select("doc_id", "text"), remainder("doc_id", 5) == 0
    machine = quality.learned(documents, table(spark, sf_dir, "labels"), "quality", ~held_out)
    score = F.col("quality_score")
    return quality.score_texts(documents, machine).select(
        "doc_id", held_out.alias("held_out"), score.alias("score"), (score >= 0.3).cast("int").alias("predicted"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of repeating words in every text, every tenth text (by hash of its id) turned into a cycle from one word on."""
    documents = table(spark, sf_dir, "documents")
    turned = documents.select("doc_id", runs.cycled(F.col("text"), F.col("doc_id")).alias("text"))
    found = runs.find_runs(turned, least_power=4, least_words=6).withColumn("best", runs.strongest(F.col("runs")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(runs.listed(F.col("runs")), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's 2,000 strongest phrases of two or three words, said ten times or more."""
    return phrases.collocations(table(spark, sf_dir, "documents"), most_words=3, least_count=10, covered_percent=50, top=2000)


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text without the lines of ten code points or more that a document of smaller id holds too."""
    cut = lines.without_shared_lines(table(spark, sf_dir, "documents"), least_documents=2, least_chars=10)
    return cut.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


QUERIES = {
    "op1_main_text": op1_main_text,
    "op2_personal_data": op2_personal_data,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_simhash": op4_simhash,
    "op5_repeats": op5_repeats,
    "op6_toxicity": op6_toxicity,
    "op7_nearest": op7_nearest,
    "op8_mixing": op8_mixing,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_quality": op10_quality,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_collocations": op12_collocations,
    "op13_line_dedup": op13_line_dedup,
}

# The rates and counts of op8 in DuckDB: sizes per source, their powers as weights, Poisson distributions, hashed uniforms.
ORACLE: dict[str, str] = {
    "op8_mixing": """
with sizes as (
    select coalesce(source, '') as s, sum(coalesce(length(text), 0))::double as size from documents group by 1),
rates as (
    select s, case when size > 0 then pow(size, 0.7) * ((sum(size) over ()) / (sum(case when size > 0 then pow(size, 0.7) else 0 end) over ()))
        / size else 0 end as rate from sizes),
steps as (
    select s, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 20)::int + 1)) as k from rates where rate > 0),
curve as (
    select s, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) over (partition by s order by k) as p from steps),
drawn as (
    select row_number() over () as r, doc_id, source, text, coalesce(source, '') as s,
        ('0x' || md5('17/' || coalesce(doc_id::varchar, ''))[1:13])::bigint / 4503599627370496.0 as u from documents),
counted as (
    select d.r, d.doc_id, d.source, d.text, count(*)::int as copies from drawn d join curve c on c.s = d.s and c.p <= d.u group by all),
copied as (
    select doc_id, source, text, unnest(range(1, copies + 1))::int as copy from counted)
select doc_id, source, text, copy,
    ('0x' || md5('18/' || coalesce(doc_id::varchar, '') || '/' || copy)[1:13])::bigint / 4503599627370496.0 as mix_position
from copied""",
    "op12_collocations": """
with pieces as (
    select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) as piece from documents),
split as (
    select lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') as w from pieces),
placed as (
    select lang, w, unnest(range(1, len(w) + 1)) as i from split),
grams as (
    select lang, 1 as k, w[i] as p from placed
    union all select lang, 2, w[i] || ' ' || w[i + 1] from placed where i + 1 <= len(w)
    union all select lang, 3, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] from placed where i + 2 <= len(w)),
counts as (
    select lang, k, p, count(*) as c from grams group by all having count(*) >= 10),
totals as (
    select lang, sum(len(w))::bigint as n from split group by lang),
cands as (
    select lang, k, p, c as a, string_split(p, ' ') as s from counts where k > 1),
cuts as (
    select lang, p, k, a, s, 1 as cut, s[1] as x, array_to_string(s[2:], ' ') as y from cands
    union all select lang, p, k, a, s, 2, s[1] || ' ' || s[2], s[3] from cands where k = 3),
scored as (
    select u.lang, u.p, u.a, u.cut, f.c as l, g.c as r, ((1000000::hugeint * u.a * u.a) // (f.c::hugeint * g.c))::bigint as score
    from cuts u join counts f on f.lang = u.lang and f.p = u.x join counts g on g.lang = u.lang and g.p = u.y),
weakest as (
    select * from scored qualify row_number() over (partition by lang, p order by score, cut) = 1),
around as (
    select lang, p, max(a) as most from (
        select lang, s[1] || ' ' || s[2] as p, a from cands where k = 3
        union all select lang, s[2] || ' ' || s[3], a from cands where k = 3) group by all),
kept as (
    select w.* from weakest w left join around o on o.lang = w.lang and o.p = w.p where o.most is null or 100 * o.most < 50 * w.a),
ranked as (
    select *, row_number() over (partition by lang order by score desc, a desc, p) as rank from kept)
select lang, rank, p as phrase, a, l, r, n, score from ranked join totals using (lang) where rank <= 2000""",
    "op13_line_dedup": """
with texts as (
    select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
placed as (
    select doc_id, unnest(lines) as line, unnest(range(len(lines))) as pos from texts),
keyed as (
    select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from placed),
shared as (
    select key, min(doc_id) as holder from keyed where length(key) >= 10 group by key having count(distinct doc_id) >= 2),
marked as (
    select k.*, s.key is not null and k.doc_id <> s.holder as gone from keyed k left join shared s on s.key = k.key)
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
    sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from marked group by doc_id""",
}
