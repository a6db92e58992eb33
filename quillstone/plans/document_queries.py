"""Document operators over whole texts of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.functions import language as L
from quillstone.functions import lexicon as X
from quillstone.functions import text as T
from quillstone.operators import chunking as C
from quillstone.operators import document_tasks as D
from quillstone.operators import entities as N
from quillstone.operators import ground as G
from quillstone.plans.registry import group
from quillstone.session import spread
from quillstone.sources.tables import table

QUERIES, SQL, query = group()


def _docs(spark, d):
    return spread(table(spark, d, "documents").select("doc_id", "text"))


_TOKENS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '')"


def packed_words(most: int) -> str:
    """CTEs up to r(doc_id, chunk_ord, chunk): words packed up to most characters, each counted with a blank."""
    return rf"""
with w as (select doc_id, {_TOKENS} as ws from documents),
c as (select doc_id, list_reduce(list_transform(ws, lambda w: [w]), lambda x, y:
        case when len(x[len(x)]) + len(y[1]) + 2 <= {most} then list_concat(x[1:len(x) - 1], [x[len(x)] || ' ' || y[1]]) else list_concat(x, y) end) as c from w where len(ws) > 0),
r as (select doc_id, cast(generate_subscripts(c, 1) - 1 as integer) as chunk_ord, unnest(c) as chunk from c)
"""


def overlapped(words: int, separator: str, least: bool) -> str:
    """CTE o(doc_id, chunk_ord, chunk) of r: with the last words of the chunk before."""
    use = f"len(string_split(before, ' ')) > {words if least else 0}"
    return f"""
, b as (select *, lag(chunk) over (partition by doc_id order by chunk_ord) as before from r),
o as (select doc_id, chunk_ord, case when before is not null and {use}
  then array_to_string(list_slice(string_split(before, ' '), greatest(len(string_split(before, ' ')) - {words - 1}, 1), len(string_split(before, ' '))), ' ') || {separator} || chunk else chunk end as chunk from b)
"""


@query(packed_words(512) + "select doc_id, chunk_ord, cast(len(string_split(chunk, ' ')) as bigint) as n_words, md5(chunk) as digest from r")
def word_chunks(spark, d):
    rows = C.chunked(_docs(spark, d), C.word_chunks(F.col("text")), "simple")
    return rows.select("doc_id", "chunk_ord", F.size(T.tokens(F.col("text"))).cast("long").alias("n_words"), F.md5(F.col("text").cast("binary")).alias("digest"))


@query(r"""
with p as (select doc_id, list_transform(string_split(text, chr(10) || chr(10)), lambda x: [x || chr(10) || chr(10)]) as ps from documents where text is not null),
c as (select doc_id, list_reduce(ps, lambda x, y: case when len(x[len(x)]) + len(y[1]) - 2 < 512 then list_concat(x[1:len(x) - 1], [x[len(x)] || y[1]]) else list_concat(x, y) end) as c from p),
t as (select doc_id, list_filter(list_transform(c, lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') as c from c)
select doc_id, cast(generate_subscripts(c, 1) - 1 as integer) as chunk_ord, md5(unnest(c)) as digest from t
""")
def paragraph_chunks(spark, d):
    rows = C.chunked(_docs(spark, d), C.paragraph_chunks(F.col("text")), "simple")
    return rows.select("doc_id", "chunk_ord", F.md5(F.col("text").cast("binary")).alias("digest"))


_FLAG_SQL = r"""
select doc_id, cast(len({tokens}) as integer) as word_count,
  regexp_matches(text, '(?i)€\s*\d+|CHF\s*\d+|\d+\s*EUR|\d+\s*CHF|maximum.*\d+|\d+%|\d+\.\d+') as has_amounts,
  regexp_matches(lower(text), 'if|when|unless|provided that|subject to|conditional|depends on|only if|in case of|se|quando|solo se|purché') as has_conditions,
  regexp_matches(lower(text), 'not covered|excluded|exception|does not apply|limitation|restriction|not eligible|shall not|non coperto|escluso|eccezione|limitazione') as has_exclusions,
  case when regexp_matches(lower(text), 'medical|mediche|hospital|doctor|treatment') then 'medical'
       when regexp_matches(lower(text), 'baggage|bagaglio|luggage|suitcase') then 'baggage'
       when regexp_matches(lower(text), 'cancellation|annullamento|cancel|trip') then 'cancellation'
       when regexp_matches(lower(text), 'delay|ritardo|late|postpone') then 'delay'
       when regexp_matches(lower(text), 'assistance|assistenza|help|support') then 'assistance'
       when regexp_matches(lower(text), 'exclusion|esclusione|not covered|except') then 'exclusions'
       when regexp_matches(lower(text), 'definition|definizione|means|refers to') then 'definitions' else 'general' end as coverage_type
from documents
""".format(tokens=_TOKENS)


@query(_FLAG_SQL)
def chunk_flags(spark, d):
    return C.annotated(_docs(spark, d)).select("doc_id", "word_count", "has_amounts", "has_conditions", "has_exclusions", "coverage_type")


@query(f"""
with f as ({_FLAG_SQL})
select coverage_type, count(*) as n, count(*) filter (has_amounts) as n_amounts, count(*) filter (has_conditions) as n_conditions,
       count(*) filter (has_exclusions) as n_exclusions, round(avg(word_count), 6) as mean_words, count(distinct doc_id) as n_docs from f group by 1
""")
def chunk_statistics(spark, d):
    return C.statistics(C.annotated(_docs(spark, d))).withColumn("mean_words", F.round("mean_words", 6))


_SENTENCES = r"""list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: trim(x)), lambda x: len(x) >= 1)"""


@query(rf"""
with s as (select doc_id, {_SENTENCES} as s from documents)
select doc_id, generate_subscripts(s, 1) - 1 as pos, md5(unnest(s)) as digest from s
""")
def sentence_split(spark, d):
    rows = _docs(spark, d).select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "s"))
    return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), F.md5(F.col("s").cast("binary")).alias("digest"))


@query(rf"""
with s as (select doc_id, unnest({_SENTENCES}) as s from documents),
n as (select doc_id, len(list_filter(regexp_split_to_array(s, '\s+'), lambda x: x <> '')) as n from s)
select doc_id, count(*) as n_sentences, round(avg(n), 6) as mean_words, round(var_pop(n), 6) as variance from n group by doc_id
""")
def sentence_stats(spark, d):
    rows = _docs(spark, d).select("doc_id", F.explode(T.sentences(F.col("text"))).alias("s")).select("doc_id", F.size(T.tokens(F.col("s"))).alias("n"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_sentences"), F.round(F.avg("n"), 6).alias("mean_words"), F.round(F.var_pop("n"), 6).alias("variance"))


@query(packed_words(512) + overlapped(5, "' '", False) + "select doc_id, chunk_ord, cast(len(string_split(chunk, ' ')) as integer) as n_words, md5(chunk) as digest from o")
def overlap_chunks(spark, d):
    rows = C.with_overlap(C.chunked(_docs(spark, d), C.word_chunks(F.col("text")), "simple"), 5)
    return rows.select("doc_id", "chunk_ord", F.size(T.tokens(F.col("text"))).alias("n_words"), F.md5(F.col("text").cast("binary")).alias("digest"))


@query(r"""
with l as (select doc_id, generate_subscripts(x, 1) as p, unnest(x) as line from (select doc_id, string_split(text, chr(10)) as x from documents)),
h as (select *, regexp_matches(trim(line), '^[A-Z][^.]{0,12}\.$') as heading from l),
s as (select *, sum(heading::int) over (partition by doc_id order by p) as section from h),
b as (select doc_id, section, coalesce(max(case when heading then trim(line) end), 'General Content') as title,
             coalesce(string_agg(line, chr(10) order by p) filter (not heading), '') as body from s group by doc_id, section)
select doc_id, section::bigint as section, title, md5(regexp_replace(body, '^\s+|\s+$', '', 'g')) as digest from b where len(regexp_replace(body, '^\s+|\s+$', '', 'g')) >= 50
""")
def section_sections(spark, d):
    heading = F.trim("line").rlike(r"^[A-Z][^.]{0,12}\.$")
    return C.sections(_docs(spark, d), heading).select("doc_id", "section", "title", F.md5(F.col("body").cast("binary")).alias("digest"))


@query(rf"""
with w as (select doc_id, unnest(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda x: len(x) > 3)) as w from documents),
c as (select doc_id, w, count(*) as n from w group by doc_id, w),
r as (select doc_id, count(*) filter (n > 1) / count(*) as ratio from c group by doc_id)
select d.doc_id, round(coalesce(ratio, 0), 6) as ratio from documents d left join r using (doc_id)
""")
def repeated_term_ratio(spark, d):
    return _docs(spark, d).select("doc_id", F.round(T.repeated_terms(F.coalesce("text", F.lit(""))), 6).alias("ratio"))


_LANG = {k: "[" + ", ".join(f"'{w}'" for w in v) + "]" for k, v in X.LANGUAGE_WORDS.items()}
_COUNTS = ", ".join(f"len(list_intersect(w, {v}))::int as {k}" for k, v in _LANG.items())
_CASES = " ".join(f"when {k} > 0 and {k} >= 1.2 * greatest({', '.join(o for o in _LANG if o != k)}) then '{k}'" for k in reversed(_LANG))


@query(rf"""
with w as (select doc_id, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}_]+')) as w from documents),
s as (select doc_id, {_COUNTS} from w)
select *, case {_CASES} else 'unknown' end as language from s
""")
def language_scores(spark, d):
    counts = L.scores(F.col("text"))
    rows = _docs(spark, d).select("doc_id", *(c.alias(k) for k, c in counts.items()))
    return rows.withColumn("language", L.decide({k: F.col(k) for k in counts}))


@query("""
with q as (select coalesce(n_chars, 0) / 4000.0 as s from documents),
b as (select case when s >= 0.9 then 'excellent' when s >= 0.8 then 'good' when s >= 0.6 then 'fair' when s >= 0.4 then 'poor' else 'very_poor' end as bucket from q)
select bucket, count(b.bucket) as n from (values ('excellent'), ('good'), ('fair'), ('poor'), ('very_poor')) x(bucket) left join b using (bucket) group by bucket
""")
def quality_histogram(spark, d):
    s = F.coalesce("n_chars", F.lit(0)) / 4000
    bucket = F.when(s >= 0.9, "excellent").when(s >= 0.8, "good").when(s >= 0.6, "fair").when(s >= 0.4, "poor").otherwise("very_poor")
    names = ("excellent", "good", "fair", "poor", "very_poor")
    counted = table(spark, d, "documents").select(bucket.alias("b")).agg(F.array(*(F.struct(F.lit(n).alias("bucket"), F.count_if(F.col("b") == n).alias("n")) for n in names)).alias("c"))
    return counted.select(F.inline("c"))


@query("select lang, source, count(*) as n, sum(n_chars)::bigint as n_chars from documents group by grouping sets ((lang), (source), ())")
def distributions(spark, d):
    return table(spark, d, "documents").groupingSets([["lang"], ["source"], []], "lang", "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"))


@query(r"""
with a as (select doc_id, regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g') as t from documents),
b as (select doc_id, translate(t, '‘’“”–—…' || chr(160) || chr(173), '''''""--. -') as t from a),
c as (select doc_id, regexp_replace(t, '([A-Za-z])-\n([a-z])', '\1\2', 'g') as t from b),
e as (select doc_id, regexp_replace(regexp_replace(t, '[ \t]+', ' ', 'g'), ' ?\n ?', chr(10), 'g') as t from c),
f as (select doc_id, regexp_replace(regexp_replace(t, '\n{3,}', chr(10) || chr(10), 'g'), ' +([,;:.!?])', '\1', 'g') as t from e)
select doc_id, md5(regexp_replace(t, '^[ \n]+|[ \n]+$', '', 'g')) as digest from f
""")
def clean_text(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(T.clean(F.col("text")).cast("binary")).alias("digest"))


@query(r"""
with l as (select doc_id, unnest(string_split(text, chr(10))) as line from documents)
select doc_id, count(*) as n_lines, count(*) filter (len(trim(line)) < 3 or regexp_matches(trim(line), '^\d+$|^[^A-Za-z0-9]+$|https?://|www\.|[A-Za-z0-9._]+@[A-Za-z0-9.]+|^\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4}$|^[Pp](age|agina) \d+')) as n_ignored
from l group by doc_id
""")
def ignored_lines(spark, d):
    return C.lines(_docs(spark, d)).groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if(T.ignorable(F.col("line"))).alias("n_ignored"))


_MENTIONS = r"""
with d as (select doc_id, text || case doc_id % 3 when 0 then ' EUR 500 is paid if the trip is cancelled. EUR 500 at most.' when 1 then ' This is excluded. Damage is not covered when late, when lost or when sold.' else ' CHF 20 in case of rain.' end as text from documents),
p as (select doc_id, k, lower(unnest(regexp_extract_all(text, p))) as entity from d, (values
  ('monetary_amount', '(?i)(?:€|EUR|CHF|USD)\s*\d+(?:,\d{3})*(?:\.\d{2})?|\d+(?:,\d{3})*(?:\.\d{2})?\s*(?:€|EUR|CHF|USD)'),
  ('condition', '(?i)\b(?:if|when|provided that|subject to|in case of)\b'),
  ('exclusion', '(?i)\b(?:excluded|not covered|exception|limitation)\b')) v(k, p))
"""


def _mentions(spark, d):
    """Mentions in the documents with a sentence added to each, as their own words hold none."""
    more = F.when(F.col("doc_id") % 3 == 0, " EUR 500 is paid if the trip is cancelled. EUR 500 at most.").when(F.col("doc_id") % 3 == 1, " This is excluded. Damage is not covered when late, when lost or when sold.").otherwise(" CHF 20 in case of rain.")
    docs = _docs(spark, d).withColumn("text", F.concat("text", more))
    return N.mentions(docs, {k: X.SENTENCE_ENTITIES[k] for k in ("monetary_amount", "condition", "exclusion")})


@query(_MENTIONS + "select k as kind, entity, count(*) as n, count(distinct doc_id) as n_docs from p group by k, entity")
def entity_mentions(spark, d):
    return _mentions(spark, d).groupBy("kind", "entity").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_docs"))


@query(_MENTIONS + "select doc_id, k as kind, entity, count(*) as n from p group by all having count(*) >= 2")
def frequent_entities(spark, d):
    return N.frequent(_mentions(spark, d))


@query(_MENTIONS + ", k as (select distinct doc_id, k from p) select x.k as a, y.k as b, count(*) as n from k x join k y on x.doc_id = y.doc_id and x.k < y.k group by all")
def entity_pairs(spark, d):
    return N.co_mentions(_mentions(spark, d))


_NORM = r"trim(regexp_replace(regexp_replace({0}, '[\"“”*`]', '', 'g'), '\s+', ' ', 'g'))"
_GRAMS = rf"""
with a as (select doc_id, regexp_split_to_array({_NORM.format('text')}, '\s+') as w from documents where text is not null),
x as (select doc_id, i, array_to_string(w[i:i+4], ' ') as g from a, unnest(generate_series(1, len(w) - 4)) t(i) where len(w) >= 5),
g as (select x.doc_id, x.i, s.g is not null as hit from x join a b on b.doc_id = x.doc_id - 1
      left join (select distinct doc_id + 1 as doc_id, g from x) s on s.doc_id = x.doc_id and s.g = x.g)
"""


def _pairs(spark, d):
    """Each document as an answer, the document before it as its source."""
    docs = _docs(spark, d).where(F.col("text").isNotNull())
    source = docs.select((F.col("doc_id") + 1).alias("doc_id"), F.col("text").alias("source"))
    return docs.join(source, "doc_id")


@query(_GRAMS + "select doc_id, count(*) as n_windows, count(*) filter (hit) as n_found from g group by doc_id")
def verbatim_5gram(spark, d):
    return G.window_counts(_pairs(spark, d))


@query(_GRAMS + """, r as (select doc_id, i, i - row_number() over (partition by doc_id order by i) as island from g where hit),
q as (select doc_id, island, count(*) + 4 as n_words from r group by doc_id, island)
select doc_id, count(*) as n_quotes, max(n_words) as longest, sum(n_words)::bigint as n_words from q group by doc_id
""")
def grounded_quotes(spark, d):
    runs = G.found_runs(_pairs(spark, d))
    return runs.groupBy("doc_id").agg(F.count("*").alias("n_quotes"), F.max("n_words").alias("longest"), F.sum("n_words").alias("n_words"))


#: Clauses put below every document for the chunkers, as the documents' own words hold no headings, entities or references.
CLAUSES = (
    "\n\n--- Page 2 ---\nSECTION A - COVER\nThe insured requires mandatory papers for every claim. The policyholder covers children up to EUR 500 a trip."
    " Trip cancellation is paid if the journey must end. See Article 7 for the exclusion of late claims.\n"
    "ARTICLE 7 - EXCLUSIONS\nBaggage that is lost is not covered if nobody reports it within 7 days. The spouse needs required proof."
    " The exception holds when EUR 500 is claimed twice. Claims after that are excluded, and the limitation of EUR 500 applies.\n"
)


def _policies(spark, d):
    return _docs(spark, d).withColumn("text", F.concat("text", F.lit(CLAUSES)))


def _strategy(name: str):
    def run(spark, d):
        rows = D.chunk_documents(_policies(spark, d), name)
        return rows.select("doc_id", "chunk_ord", "word_count", "coverage_type", "has_amounts", "has_conditions", "has_exclusions", F.round("confidence_score", 6).alias("confidence_score"), F.md5(F.col("text").cast("binary")).alias("digest"))

    run.__name__ = f"{name}_chunks"
    return run


for _name in D.STRATEGIES:
    query()(_strategy(_name))


@query()
def strategy_comparison(spark, d):
    """Chunks, mean length, kinds of cover and amounts of each strategy; one pass over the documents for each."""
    docs = _policies(spark, d)
    out = None
    for name in D.STRATEGIES:
        rows = D.chunk_documents(docs, name)
        got = rows.groupBy("strategy").agg(F.count("*").alias("n"), F.round(F.avg(F.length("text")), 4).alias("mean_length"), F.size(F.collect_set("coverage_type")).alias("kinds"), F.count_if("has_amounts").alias("n_amounts"))
        out = got if out is None else out.unionByName(got)
    return out
