"""One query per operator over the test tables, and the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from warpline.functions import text as T
from warpline.functions import udfs as U
from warpline.operators import adoption as A
from warpline.operators import entities as E
from warpline.operators import insights as I
from warpline.operators import judge as J
from warpline.operators import matching as M
from warpline.operators import origins as O
from warpline.operators import review as R
from warpline.operators import search as S
from warpline.plans.lineage import Lineage
from warpline.plans.world import TOKEN_SQL, WORLD_SQL, table, windows_sql, words_sql
from warpline.plans import store
from warpline.sources import acts, documents, dump, feedback, register

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, world: bool = False) -> Callable[[Query], Query]:
    """Registers a query under its name; ``world`` puts the SQL behind the stand-in records."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = f"with recursive {WORLD_SQL}{sql}" if world else sql
        return f

    return add


_LAST: list[Lineage] = []


def _lineage(spark: SparkSession, sf_dir: str) -> Lineage:
    """A query's own lineage. Its shared parts are tables in the shared folder, which a result may read whenever it likes."""
    while _LAST:
        _LAST.pop().close()
    _LAST.append(Lineage.of_tables(spark, sf_dir, keep=True))
    return _LAST[0]


def day(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd")


# --- Text ---------------------------------------------------------------------------------

_ANY = TOKEN_SQL[:-1] + r"|[^\s\p{L}\p{N}_])"


@query(rf"select doc_id, len(regexp_extract_all(text, '{_ANY}', 1))::int as n_tokens, len({words_sql('text')})::int as n_words from documents")
def tokens_count(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(T.tokens(F.col("text"))).alias("n_tokens"), F.size(T.words(F.col("text"))).alias("n_words"))


@query(f"select doc_id, md5(array_to_string({words_sql('text')}, ' ')) as folded from documents")
def folded_words(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(F.array_join(T.words(F.col("text")), " ")).alias("folded"))


@query(rf"""
with t as (select doc_id, regexp_extract_all(text, '{TOKEN_SQL}', 1) as f, string_split_regex(text, '{TOKEN_SQL}') as g from documents),
x as (select doc_id, unnest(f) as f, unnest(g[1:len(f)]) as g, unnest(range(len(f))) as i from t),
y as (select *, sum(length(f) + length(g)) over (partition by doc_id order by i) as e from x)
select doc_id, replace(lower(f), 'ß', 'ss') as word, (e - length(f))::int as word_start, e::int as word_end from y where regexp_matches(f, '[\p{{L}}\p{{N}}]')""")
def word_offsets(spark, d):
    rows = U.word_rows(table(spark, d, "documents"), "doc_id")
    return rows.select("doc_id", "word", F.col("start").alias("word_start"), F.col("end").alias("word_end"))


@query(f"select doc_id, count(*) as windows, count(distinct gram) as different from ({windows_sql(f'(select doc_id, {words_sql('text')} as w from documents)', 'doc_id')}) group by doc_id")
def shingles8(spark, d):
    rows = M.exploded_windows(M.with_words(table(spark, d, "documents")), "doc_id")
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("windows"), F.countDistinct("gram").alias("different"))


@query(f"""select item_id, 'phrase:' || substr(sha256(array_to_string({words_sql("text")}, ' ')), 1, 16) as phrase_id,
'phrase:' || substr(sha256('place:b:' || item_id || ':0:' || len({words_sql("text")})), 1, 16) as place_id from benchmark""")
def phrase_hash(spark, d):
    w = T.words(F.col("text"))
    article = F.concat(F.lit("b:"), F.col("item_id").cast("string"))
    return table(spark, d, "benchmark").select("item_id", T.digest(F.array_join(w, " ")).alias("phrase_id"), T.place_digest(article, F.lit(0), F.size(w)).alias("place_id"))


@query("""select page_id, trim(regexp_replace(url, '[^A-Za-z0-9._-]+', '-', 'g'), '-') as part, 'doc:web:' || trim(regexp_replace(url, '[^A-Za-z0-9._-]+', '-', 'g'), '-') as document_id,
trim(regexp_replace(url, '[^A-Za-z0-9]+', '-', 'g'), '-') as slug from pages""")
def canonical_id(spark, d):
    return table(spark, d, "pages").select("page_id", T.id_part(F.col("url")).alias("part"), T.document_id("web", F.col("url")).alias("document_id"), T.procedure_slug(F.col("url")).alias("slug"))


@query("""select o_orderkey, 'COM(' || year(o_orderdate) || ')' || (o_orderkey % 9000 + 1) || ',COM(2020)842' as refs, '5' || year(o_orderdate) || 'PC' || lpad((o_orderkey % 9000 + 1)::varchar, 4, '0') as celex,
'COM(' || year(o_orderdate) || ')' || (o_orderkey % 9000 + 1) as back from orders""")
def com_references(spark, d):
    year, n = F.year("o_orderdate").cast("string"), F.col("o_orderkey") % 9000 + 1
    text = F.concat(F.lit("Proposal COM("), year, F.lit(") "), F.lpad(n.cast("string"), 4, "0"), F.lit(" and COM(2020)842; see COM("), year, F.lit(")"), n.cast("string"))
    rows = table(spark, d, "orders").select("o_orderkey", T.com_references(text).alias("r"))
    celex = T.proposal_celex(F.get("r", F.lit(0)))
    return rows.select("o_orderkey", F.array_join("r", ",").alias("refs"), celex.alias("celex"), T.celex_com(celex).alias("back"))


@query("""select o_orderkey, case o_orderkey % 4 when 0 then 'procedure' when 1 then 'celex' when 2 then 'com' else 'title' end as kind,
case o_orderkey % 4 when 0 then year(o_orderdate) || '/' || lpad((o_orderkey % 900)::varchar, 4, '0') || '(COD)' when 1 then '3' || year(o_orderdate) || 'R' || lpad((o_orderkey % 9000)::varchar, 4, '0')
when 2 then 'COM(' || year(o_orderdate) || ')' || (o_orderkey % 900) else 'Act of ' || o_orderpriority end as value from orders""")
def parse_query(spark, d):
    year, k = F.year("o_orderdate").cast("string"), F.col("o_orderkey")
    n = (k % 900).cast("string")
    typed = (
        F.when(k % 4 == 0, F.concat(F.lit("  "), year, F.lit(" / "), n, F.lit(" (cod) "))).when(k % 4 == 1, F.concat(F.lit("celex: 3"), year, F.lit("r"), F.lpad((k % 9000).cast("string"), 4, "0")))
        .when(k % 4 == 2, F.concat(F.lit("com ("), year, F.lit(") "), n, F.lit(" final"))).otherwise(F.concat(F.lit("Act   of "), F.col("o_orderpriority")))
    )
    return table(spark, d, "orders").select("o_orderkey", T.query_kind(typed).alias("q")).select("o_orderkey", "q.kind", "q.value")


@query("""with x as (select l_orderkey, l_linenumber, lower(l_linestatus) || ' ' || lower(l_returnflag) as t from lineitem)
select l_orderkey, l_linenumber, l_orderkey % 5 < 4 as citation from x""")
def citation_flag(spark, d):
    rows = table(spark, d, "lineitem")
    tail, k = F.concat_ws(" ", F.lower("l_linestatus"), F.lower("l_returnflag")), F.col("l_orderkey") % 5
    text = (
        F.when(k == 0, F.concat_ws(" ", F.lit("the european parliament and of the council of"), tail)).when(k == 1, F.concat_ws(" ", F.lit("regulation eu 2016 679"), tail))
        .when(k == 2, F.concat_ws(" ", F.lit("a request and repealing council directives"), tail)).when(k == 3, F.concat_ws(" ", F.lit("annex to oj l"), tail))
        .otherwise(F.concat_ws(" ", F.lit("we ask for more time than regulation eu 2016 says"), tail))
    )
    return rows.select("l_orderkey", "l_linenumber", T.is_citation(F.split(text, " ")).alias("citation"))


@query("""select s_suppkey, case s_suppkey % 4 when 0 then 'Art. ' || s_nationkey when 1 then 'Art. ' || s_nationkey || '(' || s_suppkey || ')' when 2 then 'Recital ' || s_suppkey else 'Annex IV' end as label from supplier""")
def provision_label(spark, d):
    k = F.col("s_suppkey")
    local = F.when(k % 4 == 0, F.concat(F.lit("article-"), F.col("s_nationkey"))).when(k % 4 == 1, F.concat_ws("-", F.lit("article"), F.col("s_nationkey"), k)).when(k % 4 == 2, F.concat(F.lit("recital-"), k)).otherwise(F.lit("annex-iv"))
    return table(spark, d, "supplier").select("s_suppkey", T.provision_label(F.concat(F.lit("art:32024R1689:"), local)).alias("label"))


@query("""with x as (select p_partkey, lower(p_name || ' ' || p_type || ' of the EU') as t from part)
select p_partkey, array_to_string(list_filter(string_split(t, ' '), lambda w: w not in ('the', 'of', 'and', 'for', 'european', 'europe', 'eu')), ' ') as name_key, 1::int as scope from x""")
def name_normalise(spark, d):
    name = F.concat(F.initcap("p_name"), F.lit(" "), F.col("p_type"), F.lit(" of the E.U., G.m.b.H."))
    scoped = F.concat(F.col("p_name"), F.lit(" of the EU"))
    return table(spark, d, "part").select("p_partkey", T.name_key(name).alias("name_key"), T.scope_words(scoped).alias("scope"))


@query("""select p_partkey, array_to_string(list_sort(list_distinct(string_split(p_name, ' '))), ' ') as words from part""")
def title_words(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(F.array_sort(T.title_words(F.concat(F.lit("Regulation on the "), F.initcap("p_name")))), " ").alias("words"))


@query("""select c_custkey, case when c_custkey % 3 = 0 then 'stricter' when c_custkey % 3 = 1 then 'weaker' else 'unknown' end as direction from customer""")
def change_direction(spark, d):
    k = F.col("c_custkey")
    word = lambda o, w: F.struct(F.lit(o).alias("operation"), F.lit(w).alias("word"))
    words = F.when(k % 3 == 0, F.array(word("insert", "Shall,"), word("delete", "may"))).when(k % 3 == 1, F.array(word("delete", "must"), word("insert", "agree"))).otherwise(F.array(word("insert", "shall"), word("insert", "may")))
    return table(spark, d, "customer").select("c_custkey", T.direction(words).alias("direction"))


@query("select conv_id, turn, sha256(conv_id || chr(0) || role || chr(0) || text || chr(0)) as key from conversations")
def input_hash(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.input_hash(F.col("conv_id"), F.col("role"), F.col("text")).alias("key"))


# --- Matching and adoption ----------------------------------------------------------------

_RUNS = f"""
, hits as (
    select a.amendment_id, a.place_, list(distinct {{'article_id': n.article_id, 'shift': n.place_ - a.place_}}) as diagonals
    from ({windows_sql("amendments", "amendment_id")}) a join novel n using (gram) group by all
), folded(amendment_id, place_, start, cur) as (
    select amendment_id, place_, place_, diagonals from hits h where not exists (select 1 from hits p where p.amendment_id = h.amendment_id and p.place_ = h.place_ - 1)
    union all
    select h.amendment_id, h.place_, case when len(list_intersect(f.cur, h.diagonals)) > 0 then f.start else h.place_ end,
        case when len(list_intersect(f.cur, h.diagonals)) > 0 then list_intersect(f.cur, h.diagonals) else h.diagonals end
    from folded f join hits h on h.amendment_id = f.amendment_id and h.place_ = f.place_ + 1
), closed as (
    select amendment_id, start, max(place_) + 8 as stop, arg_max(cur, place_) as diagonals from folded group by amendment_id, start
), rare as (
    select c.amendment_id, c.start from (select c.*, unnest(list_distinct(a.w[c.start + 1:c.stop])) as word from closed c join amendments a using (amendment_id)) c
    where word not in (select word from common_words) group by all having count(*) >= 3
), runs as (
    select amendment_id, start, stop, unnest(diagonals) as g from closed semi join rare using (amendment_id, start)
), places as (
    select distinct amendment_id, article_id, unnest(range(p, p + stop - start)) as position from (select amendment_id, start, stop, g.article_id as article_id, start + g.shift as p from runs)
), islands as (
    select article_id, position, position - row_number() over (partition by article_id order by position) as island from (select distinct article_id, position from places)
), phrases as (
    select 'phrase:' || substr(sha256('place:' || article_id || ':' || first || ':' || stop), 1, 16) as phrase_id, x.article_id, first, stop, stop - first as words, array_to_string(a.w[first + 1:stop], ' ') as text
    from (select article_id, min(position) as first, max(position) + 1 as stop from islands group by article_id, island) x join articles a using (article_id)
), carried as (
    select distinct p.phrase_id, c.amendment_id from places c join phrases p on p.article_id = c.article_id and c.position >= p.first and c.position < p.stop
)
"""


def lineage_sql(tail: str) -> str:
    return _RUNS + tail


@query(" select word, count(*) as provisions, (select count(*) from articles) as total, count(*) >= greatest(2.0, 0.05 * (select count(*) from articles)) as common from (select distinct article_id, unnest(w) as word from articles) group by word", True)
def rarity_df(spark, d):
    return M.word_frequencies(_lineage(spark, d).article_words)


@query(" select article_id, place_, md5(gram) as gram from novel", True)
def novel_windows(spark, d):
    return M.novel_windows(_lineage(spark, d).article_words).select("article_id", F.col("at").alias("place_"), F.md5("gram").alias("gram"))


@query(lineage_sql(" select amendment_id, start as run_start, stop as run_end, g.article_id as article_id, start + g.shift as position from runs"), True)
def adopted_runs(spark, d):
    return _lineage(spark, d).runs.select("amendment_id", F.col("start").alias("run_start"), F.col("end").alias("run_end"), "article_id", "position")


@query(lineage_sql(" select phrase_id, article_id, first as first_word, stop as end_word, words, text from phrases"), True)
def adopted_phrases(spark, d):
    return _lineage(spark, d).phrases.select("phrase_id", "article_id", F.col("first").alias("first_word"), F.col("end").alias("end_word"), "words", "text")


@query()
def quoted_phrases(spark, d):
    x = _lineage(spark, d)
    return A.quoted_phrases(x.phrases, x.articles).select("phrase_id", "article_id", "span_start", "span_end", "quote")


@query(lineage_sql(" select phrase_id, amendment_id from carried"), True)
def phrase_carriers(spark, d):
    return _lineage(spark, d).carried


@query(lineage_sql("""
, pos as (select distinct amendment_id, unnest(range(start, stop)) as p from runs)
select amendment_id, string_agg(phrase_id, ',' order by phrase_id) as phrase_ids, any_value((select count(*) from pos where pos.amendment_id = c.amendment_id)) as adopted_words,
    any_value((select len(w) from amendments a where a.amendment_id = c.amendment_id)) as inserted_words, any_value((select len(w) from amendments a where a.amendment_id = c.amendment_id)) as new_words,
    any_value((select max(stop - start) from runs r where r.amendment_id = c.amendment_id)) as longest_run
from carried c group by amendment_id"""), True)
def amendment_adoptions(spark, d):
    x = _lineage(spark, d)
    return A.amendment_adoptions(x.runs, x.carried, x.amendment_words)


@query(lineage_sql(" select (select count(*) from (select distinct article_id, unnest(range(place_, place_ + 8)) from novel)) as changed_units, (select count(*) from (select distinct article_id, position from places)) as linked_units"), True)
def changed_units(spark, d):
    x = _lineage(spark, d)
    return A.unit_counts(x.runs, x.article_words)


@query(" select case when max((stage = 'final_act')::int) = 1 and max((stage = 'proposal')::int) = 1 then 'computed' else 'unknown' end as status, null::varchar as reason from articles", True)
def adoption_status(spark, d):
    return A.adoption_status(_lineage(spark, d).articles)


_HOLD = """
, tablers as (select amendment_id, author_id as holder, 'mep' as kind, author_id as name, author_group as grp from amendments)
, keys as (select amendment_id, holder, kind, name from tablers union select amendment_id, 'group:' || grp, 'group', grp from tablers where grp is not null)
, held as (select distinct phrase_id, holder, kind, name from carried join keys using (amendment_id))
, sizes as (select phrase_id, count(*) filter (kind = 'group') as g, count(*) filter (kind = 'mep') as m from held group by phrase_id)
, wording as (select amendment_id, array_to_string(w, ' ') as wording from amendments)
, credit as (
    select replace(h.holder, 'group:', '') as holder_id, kind as holder_kind, name, count(*) as phrases, sum(case when case when kind = 'group' then g else m end > 1 then 1 else 0 end)::bigint as joint_phrases,
        any_value((select count(distinct wording) from carried join keys using (amendment_id) join wording using (amendment_id) where keys.holder = h.holder)) as amendments,
        any_value((select count(distinct wording) from keys join wording using (amendment_id) where keys.holder = h.holder)) as amendments_tabled
    from held h join sizes using (phrase_id) group by h.holder, kind, name
)
"""


@query(" select amendment_id, author_id as holder, 'mep' as kind, author_id as name, author_group as tabling_group from amendments", True)
def holders(spark, d):
    return _lineage(spark, d).tablers.withColumnRenamed("group", "tabling_group")


@query(lineage_sql(_HOLD + " select * from credit"), True)
def credits(spark, d):
    return _lineage(spark, d).credits


@query(lineage_sql(_HOLD + " select *, round(amendments / amendments_tabled, 9) as rate, row_number() over (partition by holder_kind order by amendments / amendments_tabled desc, amendments_tabled desc, phrases desc, holder_id)::int as place from credit"), True)
def credit_rank(spark, d):
    return A.ranked_credits(_lineage(spark, d).credits).withColumn("rate", F.round("rate", 9))


@query(lineage_sql(_HOLD + " select count(distinct phrase_id) as phrases_without_group from carried where phrase_id not in (select phrase_id from held where kind = 'group')"), True)
def phrases_without_group(spark, d):
    x = _lineage(spark, d)
    return A.phrases_without_group(x.carried, x.tablers)


@query(lineage_sql(" select phrase_id, count(distinct author_group) as groups from carried join amendments using (amendment_id) group by phrase_id having count(distinct author_group) >= 2"), True)
def coalition_phrases(spark, d):
    x = _lineage(spark, d)
    return A.coalition_phrases(x.carried, x.tablers)


@query(" select amendment_id, author_id, case when substr(amendment_id, 4)::bigint % 3 = 0 then author_group else 'latest' end as grp from amendments", True)
def tabling_groups(spark, d):
    x = _lineage(spark, d)
    third = F.substring("amendment_id", 4, 20).cast("long") % 3 == 0
    rows = x.authored.withColumn("author_groups", F.when(third, F.col("author_groups")).otherwise(F.expr("cast(array() as array<string>)")))
    latest = x.amendments.select("author_id").distinct().withColumn("group", F.lit("latest"))
    return A.recorded_groups(rows, latest).withColumnRenamed("group", "grp")


# --- Origins ------------------------------------------------------------------------------


def longest_sql(name: str, left: str, right: str, hits: str, words: str) -> str:
    """``name``: the longest significant run per pair of ``hits`` (left, right, place_, other_at)."""
    return f"""
, {name}_h as ({hits}), {name}_i as (
    select {left}, {right}, place_ - other_at as dg, place_, min(place_) over (partition by {left}, {right}, place_ - other_at) as met, place_ - row_number() over (partition by {left}, {right}, place_ - other_at order by place_) as island
    from (select distinct {left}, {right}, place_, other_at from {name}_h)
), {name}_r as (
    select {left}, {right}, dg, min(met) as met, min(place_) as first, max(place_) + 8 as stop from {name}_i group by {left}, {right}, dg, island
), {name}_s as (
    select r.{left}, r.{right}, dg, first from (select r.*, unnest(list_distinct(w[first + 1:stop])) as word from {name}_r r join {words} using ({left})) r
    where word not in (select word from common_words) group by all having count(*) >= 3
), {name} as (
    select {left}, {right}, first, stop, stop - first as words from (select *, row_number() over (partition by {left}, {right} order by stop - first desc, met, met - dg, first) as n from {name}_r semi join {name}_s using ({left}, {right}, dg, first)) where n = 1
)"""


_ORIGIN_HITS = f"""select document_id, phrase_id, c.place_, p.place_ as other_at from ({windows_sql("consultations", "document_id")}) c
join ({windows_sql("(select phrase_id, string_split(text, ' ') as w from phrases)", "phrase_id")}) p using (gram)"""
_ORIGINS = longest_sql("said", "document_id", "phrase_id", _ORIGIN_HITS, "consultations") + """
, dated as (
    select phrase_id, string_agg(distinct amendment_id, ',' order by amendment_id) as amendment_ids, case when count(*) = count(tabled_on) then min(tabled_on) end as earliest_on
    from carried join amendments using (amendment_id) group by phrase_id
), origins as (
    select s.document_id, s.phrase_id, first, stop, words, amendment_ids, earliest_on, c.published_on, c.organisation, c.published_on < earliest_on as precedes,
        case when c.published_on < earliest_on then 'ask_first' when c.published_on >= earliest_on then 'amendment_first' else 'unknown_date' end as eligibility, false as is_citation, 'verbatim' as kind
    from said s join dated using (phrase_id) join consultations c using (document_id)
)
"""  # No run of these documents cites an act; the flag has its own query.


@query(lineage_sql(_ORIGINS + " select document_id, phrase_id, first as first_word, stop as end_word, words, amendment_ids, eligibility, is_citation from origins"), True)
def origin_matches(spark, d):
    return _lineage(spark, d).origins.select("document_id", "phrase_id", F.col("first").alias("first_word"), F.col("end").alias("end_word"), "words", "amendment_ids", "eligibility", "is_citation")


@query(lineage_sql(_ORIGINS + " select document_id, phrase_id, strftime(published_on, '%Y-%m-%d') as published_on, strftime(earliest_on, '%Y-%m-%d') as earliest_on, precedes, organisation from origins"), True)
def origin_timing(spark, d):
    return _lineage(spark, d).origins.select("document_id", "phrase_id", day("published_on").alias("published_on"), day("earliest_on").alias("earliest_on"), "precedes", "organisation")


@query(lineage_sql(_ORIGINS + " select document_id, phrase_id, words from origins where eligibility = 'ask_first' and not is_citation"), True)
def counting_origins(spark, d):
    return O.counts_as_origin(_lineage(spark, d).origins).select("document_id", "phrase_id", "words")


_TABLED_HITS = f"""select document_id, amendment_id, c.place_, a.place_ as other_at from ({windows_sql("consultations", "document_id")}) c
join ({windows_sql("amendments", "amendment_id")}) a using (gram) where gram not in (select gram from proposal_grams)"""
_TABLED = longest_sql("asked", "document_id", "amendment_id", _TABLED_HITS, "consultations") + f"""
, asked_text as (select q.*, c.w[first + 1:stop] as w from asked q join consultations c using (document_id))
, fresh as (
    select distinct document_id, amendment_id from ({windows_sql("asked_text", "document_id, amendment_id")})
    where gram not in (select gram from ({windows_sql("(select phrase_id, string_split(text, ' ') as w from phrases)", "phrase_id")}))
), tabled_runs as (
    select document_id, amendment_id, words, array_to_string(w, ' ') as text, 'phrase:' || substr(sha256(array_to_string(w, ' ')), 1, 16) as phrase_id from asked_text semi join fresh using (document_id, amendment_id)
)
"""


@query(lineage_sql(_TABLED + " select phrase_id, any_value(text) as text, any_value(words) as words, string_agg(distinct amendment_id, ',' order by amendment_id) as amendment_ids from tabled_runs group by phrase_id"), True)
def tabled_phrases(spark, d):
    return _lineage(spark, d).tabled[0]


@query(lineage_sql(_TABLED + """ select document_id, phrase_id, string_agg(distinct amendment_id, ',' order by amendment_id) as amendment_ids,
    strftime(case when count(*) = count(tabled_on) then min(tabled_on) end, '%Y-%m-%d') as earliest_on from tabled_runs join amendments using (amendment_id) group by document_id, phrase_id"""), True)
def tabled_origins(spark, d):
    return _lineage(spark, d).tabled[1].select("document_id", "phrase_id", "amendment_ids", day("earliest_on").alias("earliest_on"))


@query("select 'none' as problem, 'none' as key where false")
def dangling_references(spark, d):
    x = _lineage(spark, d)
    return O.dangling(x.phrases, x.tabled[0], x.origins, x.carried, x.amendments)


@query("""select conv_id, arg_min(role, turn) as role, 'actor:' || arg_min(role, turn) as actor_id from conversations where role <> 'system' group by conv_id""")
def passage_submitters(spark, d):
    rows = table(spark, d, "conversations")
    passages = rows.select(F.col("conv_id").alias("document_id"), F.concat(F.lit("actor:"), "role").alias("actor_id"), F.col("turn").alias("passage_order"))
    actors = rows.select(F.concat(F.lit("actor:"), "role").alias("actor_id"), F.lit("organisation").alias("kind"), F.col("role").alias("name")).distinct().where("name <> 'system'")
    return O.submitters(passages, actors).select(F.col("document_id").alias("conv_id"), F.col("name").alias("role"), "actor_id")


@query("""select c_custkey, case when c_custkey % 3 = 0 then null when c_custkey % 3 = 1 then c_name when c_custkey % 2 = 0 then c_mktsegment end as organisation from customer""")
def shown_organisation(spark, d):
    k = F.col("c_custkey")
    kind = F.when(k % 3 == 0, "citizens").when(k % 3 == 1, "organisation")
    source = F.when(k % 2 == 0, "hys_feedback").otherwise("hys_attachment")
    return table(spark, d, "customer").select("c_custkey", O.organisation(kind, F.col("c_name"), source, F.col("c_mktsegment")).alias("organisation"))


# --- Search -------------------------------------------------------------------------------


def _document_passages(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("passage_id"), F.col("doc_id").alias("place"), T.words(F.col("text")).alias("w"))


_BM25 = f"""with p as (select doc_id::varchar as passage_id, doc_id as place, {words_sql("text")} as w from documents),
c as (select passage_id, term, count(*) as n from (select passage_id, unnest(w) as term from p) group by all),
t as (select term, count(*) as df, ln(1 + ((select count(*) from p) - count(*) + 0.5) / (count(*) + 0.5)) as idf from c group by term)"""


@query(_BM25 + " select term, df, round(idf, 6) as idf from t")
def bm25_idf(spark, d):
    return S.term_statistics(_document_passages(spark, d))[1].select("term", "df", F.round("idf", 6).alias("idf"))


@query(_BM25 + f""", x as (select passage_id, term, idf * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(w) / (select avg(len(w)) from p))) as weight from c join t using (term) join p using (passage_id)),
q as (select item_id::varchar as query_id, unnest(list_distinct({words_sql("text")})) as term from benchmark),
s as (select query_id, passage_id, sum(weight) as score from q join x using (term) group by all),
r as (select query_id, passage_id, score, row_number() over (partition by query_id order by round(score, 9) desc, passage_id::bigint)::int as rank from s)
select query_id, passage_id, round(score, 6) as score, rank from r where rank <= 5""")
def bm25_topk(spark, d):
    asked = table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), T.words(F.col("text")).alias("terms"))
    return S.bm25(_document_passages(spark, d), asked).withColumn("score", F.round("score", 6))


@query()
def passage_context(spark, d):
    return S.with_context(S.passage_rows(table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("document_id"), "text"))).drop("text")


def _asks(spark, d):
    return table(spark, d, "conversations").select(F.concat_ws(":", F.lit("ask"), "conv_id", "turn").alias("ask_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("place"), "text")


@query()
def candidates(spark, d):
    changes = table(spark, d, "benchmark").select(F.concat(F.lit("am:"), F.col("item_id").cast("string")).alias("amendment_id"), F.lit(None).cast("string").alias("old_text"), F.col("text").alias("new_text"))
    return S.candidates(changes, _asks(spark, d))[0].withColumn("score", F.round("score", 6))


@query(rf"""select 'ask:' || conv_id || ':' || turn as ask_id, trim(text) <> '' and length(text) <= 12000 and len(regexp_extract_all(text, '{_ANY}', 1)) <= 800 as valid from conversations""")
def ask_bounds(spark, d):
    return _asks(spark, d).select("ask_id", S.valid_change(F.lit(None).cast("string"), F.col("text")).alias("valid"))


_TITLES = """with t as (select p_partkey as title_id, list_distinct(string_split(p_name || ' ' || lower(p_type), ' ')) as tw from part),
q as (select row_number() over (order by p_name) - 1 as query_id, list_distinct(string_split(p_name, ' ')) as qw from (select distinct p_name from part)),
s as (select query_id, title_id, len(list_intersect(qw, tw)) / len(qw) * 0.9 + len(list_intersect(qw, tw)) / len(tw) * 0.1 as score from q, t where len(list_intersect(qw, tw)) > 0),
r as (select *, row_number() over (partition by query_id order by round(score, 9) desc, title_id)::int as rank from s where score >= 0.5)"""


@query(_TITLES + """ select query_id, title_id, round(score, 6) as score, rank, coalesce((select b.score from r b where b.query_id = r.query_id and b.rank = 2) >= 0.97 * (select b.score from r b where b.query_id = r.query_id and b.rank = 1), false) as ambiguous from r where rank <= 3""")
def title_search(spark, d):
    parts = table(spark, d, "part")
    titles = parts.select(F.col("p_partkey").alias("title_id"), F.concat_ws(" ", "p_name", "p_type").alias("title"))
    asked = parts.select("p_name").distinct().select((F.row_number().over(Window.orderBy("p_name")) - 1).cast("long").alias("query_id"), F.col("p_name").alias("query"))
    return S.title_scores(titles, asked).withColumn("score", F.round("score", 6))


@query("""with a as (select n_nationkey as title_id, lower(replace(n_name, '_', ' ')) as key from nation), t as (select r_regionkey + 100 as title_id, lower(r_name) as key from region union all select title_id, key from a where title_id % 2 = 0),
q as (select c_custkey as query_id, lower(replace(n_name, '_', ' ')) as key from customer join nation on c_nationkey = n_nationkey)
select query_id, case when title_id % 2 = 0 then 'chosen' else 'missing' end as status, title_id::varchar as title_ids from q join a using (key)""")
def alias_search(spark, d):
    nations, regions = table(spark, d, "nation"), table(spark, d, "region")
    aliases = nations.select(F.col("n_nationkey").alias("title_id"), U.caseless_key(F.concat(F.lit("The "), F.replace("n_name", F.lit("_"), F.lit("-")))).alias("key"))
    titles = regions.select((F.col("r_regionkey") + 100).alias("title_id"), U.caseless_key("r_name").alias("key")).unionByName(aliases.where("title_id % 2 = 0"))
    asked = table(spark, d, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("query_id"), U.caseless_key(F.replace("n_name", F.lit("_"), F.lit(" "))).alias("key"))
    return S.by_alias(asked, aliases, titles)


# --- Entities -----------------------------------------------------------------------------


def _entries(spark, d):
    n = F.col("n_nationkey").cast("string")
    return table(spark, d, "nation").select(
        F.concat(F.lpad(n, 6, "0"), F.lit("-12")).alias("register_id"), F.array(F.concat(F.lit("Union of "), F.translate("n_name", "_0123456789", " abcdefghij")), F.lit(None).cast("string")).alias("names"),
        F.concat(F.lit("U"), n).alias("acronym"), F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("country"),
    )


def _mentions(spark, d, third="Unionn of "):
    """All suppliers as mentions of nations in seven spellings, ``third`` before the name in one of them."""
    k = F.col("s_suppkey")
    name = F.translate(F.concat(F.lit("NATION_"), F.col("s_nationkey").cast("string")), "_0123456789", " abcdefghij")
    spelling = (
        F.when(k % 7 == 0, F.concat(F.lit("union  of "), F.lower(name), F.lit(", GmbH"))).when(k % 7 == 1, F.concat(F.lit("European Union of "), name)).when(k % 7 == 2, F.concat(F.lit("U"), F.col("s_nationkey")))
        .when(k % 7 == 3, F.concat(F.lit(third), name)).otherwise(F.col("s_name"))
    )
    code = F.when(k % 7 == 4, F.concat(F.lit(" "), F.lpad(k.cast("string"), 7, "0"), F.lit("-01 ")))
    return table(spark, d, "supplier").select(k.alias("mention_id"), spelling.alias("spelling"), code.alias("register_id"), F.when(k % 7 == 5, "EU_CITIZEN").alias("user_type"), F.lit(None).cast("string").alias("country"))


@query()
def resolve_names(spark, d):
    return E.resolve(_mentions(spark, d), _entries(spark, d))


@query("""select s_suppkey as mention_id, case s_suppkey % 7 when 0 then 'normalised_exact' when 1 then 'fuzzy' when 2 then 'acronym' when 4 then 'register_id' when 3 then 'normalised_exact' else 'unresolved' end as resolution from supplier""")
def resolve_exact(spark, d):
    """All mentions, none of them misspelt, as plain SQL has no similarity of names; ``resolve_names`` has those."""
    return E.resolve(_mentions(spark, d, "Union of "), _entries(spark, d)).select("mention_id", "resolution")


@query()
def resolve_fuzzy(spark, d):
    return E.fuzzy_matches(_mentions(spark, d), E.name_index(_entries(spark, d))).select("mention_id", F.round("score", 6).alias("score"), F.array_join("ids", ",").alias("ids"))


@query()
def resolution_summary(spark, d):
    """All mentions, the misspelt ones too; plain SQL has no similarity of names."""
    return E.resolution_summary(E.resolve(_mentions(spark, d), _entries(spark, d)))


@query("""select 'actor:' || source as actor_id, min(lang) as lang, string_agg(distinct lang, ',' order by lang) as aliases from documents group by source""")
def merge_actors(spark, d):
    rows = table(spark, d, "documents").select(F.concat(F.lit("actor:"), "source").alias("actor_id"), "lang", F.array("lang").alias("aliases"))
    return E.merge_actors(rows).withColumn("aliases", F.array_join("aliases", ","))


@query("""select p.event_id, coalesce(c.event_id, -1) as last_click from (select * from events where event_type = 'purchase') p asof left join (select * from events where event_type = 'click') c on p.user_id = c.user_id and p.ts >= c.ts""")
def group_asof(spark, d):
    e = table(spark, d, "events")
    clicks = e.where("event_type = 'click'").select("user_id", "ts", F.col("event_id").alias("click"))
    return E.latest_before(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), clicks, "user_id", "ts", "click").select("event_id", F.coalesce("last_click", F.lit(-1)).alias("last_click"))


@query("""with s as (select user_id, event_type as grp, ts::date as d0, lead(ts::date) over (partition by user_id order by ts, event_id) as d1 from events where event_type in ('click', 'view')),
e as (select event_id, user_id, case when event_id % 13 <> 0 then ts::date end as day from events where event_type = 'purchase')
select e.event_id, arg_max(s.grp, (s.d0, s.grp)) as grp from e left join s on e.user_id = s.user_id and e.day is not null and s.d0 <= e.day and (s.d1 is null or e.day <= s.d1) group by e.event_id""")
def group_interval(spark, d):
    e = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    spells = e.where("event_type in ('click', 'view')").select("user_id", F.col("event_type").alias("group"), F.col("day").alias("start"), F.lead("day").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("end"))
    wanted = e.where("event_type = 'purchase'").select("event_id", "user_id", F.when(F.col("event_id") % 13 != 0, F.col("day")).alias("day"))
    return E.group_on_day(wanted, spells, "user_id").select("event_id", F.col("group").alias("grp"))


# --- Insights -----------------------------------------------------------------------------

_ALL_ORIGINS = _ORIGINS + _TABLED + """
, tabled_dated as (select document_id, phrase_id, any_value(words) as words, string_agg(distinct amendment_id, ',' order by amendment_id) as amendment_ids, case when count(*) = count(tabled_on) then min(tabled_on) end as earliest_on
    from tabled_runs join amendments using (amendment_id) group by document_id, phrase_id)
, every as (
    select document_id, phrase_id, organisation, published_on, eligibility, amendment_ids from origins
    union all select document_id, phrase_id, organisation, published_on, case when published_on < earliest_on then 'ask_first' when published_on >= earliest_on then 'amendment_first' else 'unknown_date' end, amendment_ids
    from tabled_dated join consultations using (document_id)
)
"""
_RANKING = _ALL_ORIGINS + """
, ranked as (select 'name:' || organisation as org_key, organisation as name, count(distinct phrase_id) filter (phrase_id in (select phrase_id from phrases)) as adopted_first, count(distinct phrase_id) filter (phrase_id not in (select phrase_id from phrases)) as tabled_only,
    count(distinct document_id) as documents, strftime(min(published_on), '%Y-%m-%d') as first_said from every where eligibility = 'ask_first' and organisation is not null group by organisation)
"""


@query(lineage_sql(_RANKING + " select org_key, name, adopted_first, tabled_only, documents, first_said, row_number() over (order by adopted_first desc, tabled_only desc, name)::int as place from ranked"), True)
def org_ranking(spark, d):
    return _lineage(spark, d).ranking.select("org_key", "name", "adopted_first", "tabled_only", "documents", day("first_said").alias("first_said"), "place")


@query(lineage_sql(_ALL_ORIGINS + " select count(distinct document_id) filter (eligibility = 'ask_first' and organisation is null) as unnamed_documents, 0::bigint as citations, count(*) filter (eligibility <> 'ask_first') as not_first from every"), True)
def origin_totals(spark, d):
    return I.origin_totals(_lineage(spark, d).all_origins)


@query(lineage_sql(_ALL_ORIGINS + " select eligibility as timing, count(*) as n from every group by eligibility"), True)
def match_timing(spark, d):
    return I.match_timing(_lineage(spark, d).all_origins)


_ADOPTING = " , adopting as (select * from amendments semi join carried using (amendment_id)) "


@query(lineage_sql(_ADOPTING + """ select 'stage' as dimension, stage as label, count(*) as n from adopting group by stage union all select 'committee', committee, count(*) from adopting group by committee
union all select 'year', coalesce(strftime(tabled_on, '%Y'), 'Date unknown'), count(*) from adopting group by all"""), True)
def channels(spark, d):
    return I.channel_counts(_lineage(spark, d).adoptions)


@query(lineage_sql(_ADOPTING + " select count(*) as adopting, count(author_group) as with_group, 0::bigint as cross_group from adopting"), True)
def channels_groups(spark, d):
    return I.group_channels(_lineage(spark, d).adoptions)


@query(lineage_sql(_ADOPTING + " select distinct 'group' as facet, author_group as value from adopting where author_group is not null union select 'committee', committee from adopting"), True)
def phrase_facets(spark, d):
    x = _lineage(spark, d)
    return I.phrase_facets(x.carried, x.adoptions)


@query(lineage_sql(_ORIGINS + " select phrase_id from phrases where phrase_id in (select phrase_id from carried join amendments using (amendment_id) where author_group = 'g1') and phrase_id in (select phrase_id from origins) and contains(text, 'th')"), True)
def phrase_filter(spark, d):
    x = _lineage(spark, d)
    hay = I.phrase_haystacks(x.phrases, x.carried, x.adoptions, x.origins, U.search_fold)
    return I.filter_phrases(hay.withColumn("haystack", F.element_at(F.split("haystack", "\n"), 1)), query="th", group="g1", evidence="any-origin").select("phrase_id")


@query(lineage_sql(_ORIGINS + " select phrase_id, words from phrases where phrase_id in (select phrase_id from origins where eligibility = 'ask_first')"), True)
def link_pool(spark, d):
    x = _lineage(spark, d)
    return I.link_pool(x.phrases, x.origins).select("phrase_id", "words")


@query(lineage_sql(_ORIGINS + """ select phrase_id, coalesce(bool_or(eligibility = 'ask_first'), false) as asked_first, count(document_id) > 0 as has_origin, row_number() over (order by coalesce(bool_or(eligibility = 'ask_first'), false) desc, count(document_id) > 0 desc, any_value(p.words) desc, phrase_id)::int as place
from phrases p left join (select phrase_id, document_id, eligibility from origins) o using (phrase_id) group by phrase_id"""), True)
def phrase_order(spark, d):
    x = _lineage(spark, d)
    return I.by_evidence(x.phrases, x.origins).select("phrase_id", "asked_first", "has_origin", "place")


@query(lineage_sql(_RANKING + """ select 'documents_lexical' as step, (select count(distinct document_id) from every where eligibility = 'ask_first') as part, (select count(*) from consultations) as whole
union all select 'documents_semantic_only', 0, (select count(*) from consultations)
union all select 'amendments_adopting', (select count(distinct amendment_id) from carried), (select count(*) from amendments)
union all select 'changed_words_linked', (select count(*) from (select distinct article_id, position from places)), (select count(*) from (select distinct article_id, unnest(range(place_, place_ + 8)) from novel))
union all select 'organisations_adopted', (select count(*) from ranked where adopted_first > 0), (select count(*) from ranked)"""), True)
def funnel(spark, d):
    x = _lineage(spark, d)
    return I.funnel(x.documents, x.all_origins, x.amendments, x.adoptions, x.units, x.ranking)


_GRAPH = _ORIGINS + """
, paths as (select phrase_id, organisation, unnest(string_split(amendment_ids, ',')) as amendment_id from origins where eligibility = 'ask_first' and organisation is not null)
, links as (
    select distinct 'org:' || organisation as source, 'tabler:' || author_id as target, 'organisation' as source_column, 'tabler' as target_column, organisation as source_label, author_id as target_label, phrase_id from paths join amendments using (amendment_id)
    union select distinct 'tabler:' || author_id, 'prov:' || article_id, 'tabler', 'provision', author_id, string_split(article_id, ':')[-1], phrase_id from paths join amendments using (amendment_id) join phrases using (phrase_id)
)
, nodes as (select node, col as "column", min(label) as label, count(distinct phrase_id) as phrases from (select source as node, source_column as col, source_label as label, phrase_id from links union all select target, target_column, target_label, phrase_id from links) group by node, col)
"""


def _links(spark, d):
    x = _lineage(spark, d)
    return I.graph(x.origins, x.phrases, x.adoptions)


@query(lineage_sql(_GRAPH + " select source, target, count(distinct phrase_id) as phrases, string_agg(distinct phrase_id, ',' order by phrase_id) as phrase_ids, true as lexical, false as semantic from links group by source, target"), True)
def graph_edges(spark, d):
    return I.graph_edges(_links(spark, d))


@query(lineage_sql(_GRAPH + " select * from nodes"), True)
def graph_nodes(spark, d):
    return I.graph_nodes(_links(spark, d))


@query(lineage_sql(_GRAPH + """ select * from (select node, "column", label, phrases, row_number() over (partition by "column" order by phrases desc, label, node)::int as place, greatest(count(*) over (partition by "column") - 5, 0) as hidden from nodes) where place <= 5"""), True)
def graph_slice(spark, d):
    return I.slice_graph(_links(spark, d), 5)


@query("""with c as (select source as label, count(*) as n from documents group by source), r as (select *, row_number() over (order by n desc, label) as place from c)
select case when place <= 5 then label else '(rest)' end as label, sum(n)::bigint as n from r group by all""")
def counts_and_rest(spark, d):
    return I.top_and_rest(table(spark, d, "documents").groupBy(F.col("source").alias("label")).agg(F.count(F.lit(1)).alias("n")), 5)


@query(lineage_sql(_RANKING + _HOLD + _ADOPTING + """ select 'organisation' as question, (select name from ranked order by adopted_first desc, tabled_only desc, name limit 1) as answer union all select 'group', (select name from credit where holder_kind = 'group' order by phrases desc, holder_id limit 1)
union all select 'stage', (select stage from adopting group by stage order by count(*) desc, stage limit 1) union all select 'committee', (select committee from adopting group by committee order by count(*) desc, committee limit 1)"""), True)
def five_answers(spark, d):
    x = _lineage(spark, d)
    return I.answers(x.ranking, I.channel_counts(x.adoptions), x.credits)


@query(lineage_sql(_ALL_ORIGINS + """ select (select count(*) from amendments) as amendments, (select count(distinct amendment_id) from carried) as amendments_adopting, (select count(distinct phrase_id) from carried) as adopted_phrases,
(select count(distinct phrase_id) from carried where phrase_id not in (select phrase_id from carried join amendments using (amendment_id) where author_group is not null)) as phrases_without_group,
(select count(*) from consultations) as documents_read, (select count(distinct document_id) from every where eligibility = 'ask_first') as documents_with_origin,
(select count(*) from (select distinct article_id, unnest(range(place_, place_ + 8)) from novel)) as changed_units, (select count(*) from (select distinct article_id, position from places)) as linked_units"""), True)
def lineage_counts(spark, d):
    return _lineage(spark, d).counts()


# --- Review -------------------------------------------------------------------------------


def _claims(spark, d):
    x = _lineage(spark, d)
    return R.claims(x.phrases, x.carried, x.adoptions, A.coalition_phrases(x.carried, x.tablers))


@query(lineage_sql(""" select 'claim:' || phrase_id as claim_id, any_value(words) as words, string_agg(distinct amendment_id, ';' order by amendment_id) as amendment_ids, string_agg(distinct stage, ';' order by stage) as stages, coalesce(string_agg(distinct author_group, ';' order by author_group), '') as groups,
strftime(case when count(*) = count(tabled_on) then min(tabled_on) end, '%Y-%m-%d') as earliest_on, count(*) as shared_by, count(distinct author_group) >= 2 as coalition from phrases join carried using (phrase_id) join amendments using (amendment_id) group by phrase_id"""), True)
def review_claims(spark, d):
    return _claims(spark, d).select("claim_id", "words", "amendment_ids", "stages", "groups", day("earliest_on").alias("earliest_on"), "shared_by", "coalition")


@query()
def review_sample(spark, d):
    return R.review_sample(_claims(spark, d), 10, seed=7, strongest=3).select("claim_id", "selection", "draw")


def _outcomes(spark, d):
    labels = table(spark, d, "labels").withColumn("claim_id", F.concat(F.lit("claim:"), F.col("doc_id").cast("string")))
    verdict = lambda c: F.when(c == 1, "real").otherwise("not_real")
    one = labels.select("claim_id", F.lit("a").alias("reader"), verdict(F.col("quality")).alias("verdict"))
    two = labels.where("doc_id % 9 <> 0").select("claim_id", F.lit("b").alias("reader"), verdict(1 - F.col("toxic")).alias("verdict"))
    rows = labels.select("claim_id", F.when(F.col("doc_id") % 10 == 0, "strongest").otherwise("sample").alias("selection"))
    return R.claim_outcomes(rows, one.unionByName(two))


_LABELS = """with o as (select case when doc_id % 10 = 0 then 'strongest' else 'sample' end as selection, case when doc_id % 9 = 0 then 'unlabelled' when quality <> 1 - toxic then 'unresolved' when quality = 1 then 'real' else 'not_real' end as outcome from labels),
s as (select count(*) filter (selection = 'sample') as claims, count(*) filter (selection = 'sample' and outcome in ('real', 'not_real')) as resolved, count(*) filter (selection = 'sample' and outcome = 'real') as real,
count(*) filter (selection = 'sample' and outcome = 'unresolved') as unresolved, count(*) filter (selection = 'sample' and outcome = 'unlabelled') as unlabelled, count(*) filter (selection <> 'sample' and outcome = 'real') as strongest_real,
count(*) filter (selection <> 'sample' and outcome in ('real', 'not_real')) as strongest_resolved from o), z as (select *, real / resolved as p, resolved::double as n, 1.959963984540054 as z from s),
w as (select *, (p + z*z/(2*n) - z*sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n) as lo, (p + z*z/(2*n) + z*sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n) as hi from z)"""


@query(_LABELS + " select claims, resolved, real, unresolved, unlabelled, strongest_real, strongest_resolved, round(p, 9) as precision, round(lo, 9) as low, round(hi, 9) as high from w")
def review_summary(spark, d):
    return R.summarise(_outcomes(spark, d)).withColumns({c: F.round(c, 9) for c in ("precision", "low", "high")})


@query(_LABELS + " select round(lo, 9) as low, resolved >= 20 and lo >= 0.8 as passed from w")
def wilson_gate(spark, d):
    return R.gate(R.summarise(_outcomes(spark, d)), 0.8, 20).select(F.round("low", 9).alias("low"), "passed")


@query("""select 'twice' as problem, 'claim:' || doc_id as claim_id from labels where doc_id % 8 = 0""")
def label_problems(spark, d):
    labels = table(spark, d, "labels").select(F.concat(F.lit("claim:"), F.col("doc_id").cast("string")).alias("claim_id"), F.lit("a").alias("reader"), "doc_id")
    twice = labels.unionByName(labels.where("doc_id % 8 = 0"))
    return R.label_problems(labels.select("claim_id"), twice.select("claim_id", "reader"))


@query()
def draw_links(spark, d):
    pool = [r["item_id"] for r in table(spark, d, "benchmark").select("item_id").orderBy("item_id").collect()]  # a fixed, small table
    return spark.createDataFrame([(str(x), i) for i, x in enumerate(R.draw_links(pool, 3, 42))], "item string, draw int")


# --- Judged path --------------------------------------------------------------------------


@query("""select doc_id, round(least(quality * 0.9, 0.8, 1 - toxic * 0.5, 1 - 0.1), 6) as support, least(quality * 0.9, 0.8, 1 - toxic * 0.5, 0.9) >= 0.67 as counts from labels""")
def judge_support(spark, d):
    answers = F.struct((F.col("quality") * 0.9).alias("asks"), F.lit(0.8).alias("supports"), (F.col("toxic") * 0.5).alias("opposes"), F.lit(0.1).alias("incidental"))
    s = J.support(answers)
    return table(spark, d, "labels").select("doc_id", F.round(s, 6).alias("support"), (s >= J.CUTOFF).alias("counts"))


@query()
def reworded_origins(spark, d):
    x = _lineage(spark, d)
    asks = x.documents.select(F.concat(F.lit("ask:"), "document_id").alias("ask_id"), "document_id", F.xxhash64("document_id").alias("place"), "text", F.lit("").alias("context"))
    changes = table(spark, d, "benchmark").select(F.concat(F.lit("am:"), F.col("item_id").cast("string")).alias("amendment_id"), F.lit(None).cast("string").alias("old_text"), F.col("text").alias("new_text"), F.lit(None).cast("string").alias("target_provision"))
    found, _ = S.candidates(changes, asks)
    proposal = x.articles.where("stage = 'proposal'").select(F.col("article_id").alias("provision"), "article_id", "text")
    share = lambda r, p: F.pmod(F.xxhash64(F.lit(p), r), F.lit(100)) / 100.0
    pluggable = lambda df: df.select("request_hash", F.struct(share("request_hash", 1).alias("asks"), F.lit(0.9).alias("supports"), F.lit(0.0).alias("opposes"), F.lit(0.1).alias("incidental")).alias("answers"))
    scored = J.judged(J.requests(found, asks, changes, proposal), pluggable)
    days = changes.select("amendment_id", F.lit("2024-01-20").cast("date").alias("tabled_on"))
    none = spark.createDataFrame([], "document_id string, amendment_id string")
    return J.reworded_origins(scored, asks, none, x.documents, days)


# --- Functions in Python ------------------------------------------------------------------


def _turns(spark, d):
    order = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, d, "conversations").withColumn("old_text", F.lag("text").over(order)).withColumnRenamed("text", "new_text").withColumn("amendment_id", F.concat_ws(":", "conv_id", "turn"))


@query()
def inserted_words(spark, d):
    return A.with_inserted(_turns(spark, d)).select("amendment_id", "basis", F.size("w").alias("words"), F.size(F.filter("inserted", lambda x: x)).alias("inserted"))


@query()
def changed_spans(spark, d):
    rows = _turns(spark, d).where(S.valid_change(F.col("old_text"), F.col("new_text")))
    return rows.select("amendment_id", F.explode(U.changed_spans("old_text", "new_text")).alias("s")).select("amendment_id", "s.operation", F.col("s.start").alias("span_start"), F.col("s.end").alias("span_end"))


@query()
def sentences(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(U.sentence_spans("text")).alias("n", "s"))
    return rows.select("doc_id", "n", F.col("s.start").alias("span_start"), F.col("s.end").alias("span_end"), "s.words")


@query()
def passages(spark, d):
    return S.passage_rows(table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("document_id"), "text")).withColumn("text", F.md5("text"))


@query()
def packed_passages(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(U.packed_spans("text")).alias("n", "s"))
    return rows.select("doc_id", "n", F.col("s.start").alias("span_start"), F.col("s.end").alias("span_end"))


@query()
def quoted_changes(spark, d):
    text = F.concat(F.lit("In Article "), F.col("item_id").cast("string"), F.lit(", replace 'shall' with 'may' and delete \"must\"; "), F.col("text"))
    rows = table(spark, d, "benchmark").select("item_id", F.posexplode(U.read_changes(text)).alias("n", "c"))
    return rows.select("item_id", "n", "c.kind", "c.old", "c.new", F.col("c.start").alias("span_start"), F.col("c.end").alias("span_end"))


@query()
def name_keys(spark, d):
    return table(spark, d, "customer").select("c_custkey", U.caseless_key(F.concat(F.lit("The Él. "), "c_name")).alias("key"), U.search_fold("c_mktsegment").alias("folded"))


@query()
def repaired_ligatures(spark, d):
    text = F.replace(F.replace("text", F.lit("fi"), F.lit("ﬁ")), F.lit("fl"), F.lit("\0"))
    return table(spark, d, "documents").select("doc_id", U.repair_ligatures(text).alias("r")).select("doc_id", "r.guessed", "r.unresolved", F.md5("r.text").alias("text_md5"))


# --- Sources ------------------------------------------------------------------------------


@query("""select event_id, (props->>'k')::int as k from events where contains(props, '"k": 6') """)
def json_needle_scan(spark, d):
    lines = table(spark, d, "events").select("event_id", F.col("props").alias("value"))
    found = lines.where(F.col("value").contains('"k": 6'))
    return found.select("event_id", F.from_json("value", "k int")["k"].alias("k"))


@query("""select strftime(max(ts), '%Y-%m-%d') as latest from events""")
def dump_reach(spark, d):
    lines = table(spark, d, "events").select(F.concat(F.lit('{"date": "'), F.date_format("ts", "yyyy-MM-dd"), F.lit('T10:00:00"}')).alias("value"))
    return dump.latest_date(lines)


@query("""select o_orderkey, case o_orderstatus when 'F' then 'completed' when 'O' then 'ongoing' else 'withdrawn' end as status from orders""")
def procedure_status(spark, d):
    s = F.col("o_orderstatus")
    stage = F.when(s == "F", "Procedure completed - act").when(s == "O", "Awaiting committee decision").otherwise("Procedure rejected")
    return table(spark, d, "orders").select("o_orderkey", dump.status(stage).alias("status"))


def _dossiers(spark, d):
    o = table(spark, d, "orders")
    key, date = F.lpad((F.col("o_orderkey") % 10000).cast("string"), 4, "0"), F.date_format("o_orderdate", "yyyy-MM-dd'T'00:00:00")
    reference = F.when(F.col("o_orderkey") % 7 == 0, F.concat(F.lit("COM(2020)"), key)).otherwise(F.concat(F.lit("2020/"), key, F.lit("(COD)")))
    record = F.struct(
        F.struct(reference.alias("reference"), F.concat(F.lit(" Title "), key).alias("title"), F.lit("Procedure completed").alias("stage_reached"), F.to_json(F.create_map(F.lit("4.10"), F.col("o_orderpriority"))).alias("subject")).alias("procedure"),
        F.array(F.struct(date.alias("date"), F.lit("Legislative proposal published").alias("type"), F.array(F.struct(F.concat(F.lit("COM(2020)"), key).alias("title"))).alias("docs"))).alias("events"),
        F.array(F.struct(F.lit("Responsible Committee").alias("type"), F.lit('["LIBE","IMCO"]').alias("committee"))).alias("committees"),
    )
    return o.select("o_orderkey", F.concat(F.lit(","), F.to_json(record)).alias("value"))


@query("""select '2020/' || lpad((o_orderkey % 10000)::varchar, 4, '0') || '(COD)' as procedure_id, 'Title ' || lpad((o_orderkey % 10000)::varchar, 4, '0') as title, 'completed' as status, 'COM(2020)' || (o_orderkey % 10000) as com, strftime(o_orderdate, '%Y-%m-%d') as proposed_on, 'LIBE/IMCO' as lead_committee, '4.10 ' || o_orderpriority as subject
from orders where o_orderkey % 7 <> 0""")
def procedure_catalog(spark, d):
    lines = dump.dump_lines(spark, _dossiers(spark, d).select("value"))
    entries, _ = dump.catalog(dump.read_dump(lines, dump.DOSSIER))
    return entries.select("procedure_id", "title", "status", F.get("com_references", F.lit(0)).alias("com"), day("proposed_on").alias("proposed_on"), "lead_committee", F.get("subjects", F.lit(0)).alias("subject"))


@query("""select 'reference_not_a_procedure' as reason, count(*) as n from orders where o_orderkey % 7 = 0""")
def catalog_skipped(spark, d):
    lines = dump.dump_lines(spark, _dossiers(spark, d).select("value"))
    return dump.catalog(dump.read_dump(lines, dump.DOSSIER))[1]


def _amendment_records(spark, d):
    t = table(spark, d, "conversations")
    source = F.when(F.col("turn") == 7, F.lit(" ")).otherwise(F.concat_ws("-", "conv_id", (F.col("turn") / 2).cast("int")))
    return t.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("place"), F.lit("2021/0106(COD)").alias("reference"), source.alias("id"), F.col("turn").cast("string").alias("seq"), F.lit("2024-02-01T00:00:00").alias("date"),
        F.lit('["IMCO","LIBE"]').alias("committee"), F.lit('[["Article 1","Title"],"Recital 2"]').alias("location"), F.lit(None).cast("string").alias("old"), F.to_json(F.array("text")).alias("new"),
        F.array(F.col("conv_id")).alias("meps"), F.lit("A  B, C").alias("authors"), F.lit(None).cast("string").alias("justification"), F.lit("EN").alias("orig_lang"),
    )


@query("""with x as (select *, row_number() over (partition by conv_id, turn // 2 order by turn) as n from conversations where turn <> 7 and trim(text) <> '')
select 'am:2021-0106-COD:IMCO-LIBE:' || conv_id || '-' || (turn // 2) as amendment_id, 'actor:mep:' || conv_id as author, 'A B|C' as names, 'Article 1 - Title; Recital 2' as target, md5(text) as new_md5 from x where n = 1""")
def stage_dedupe(spark, d):
    kept, _ = dump.amendments(_amendment_records(spark, d), "2021/0106(COD)", "committee")
    return kept.select("amendment_id", F.get("author_ids", F.lit(0)).alias("author"), F.array_join("author_names", "|").alias("names"), F.col("target_provision").alias("target"), F.md5("new_text").alias("new_md5"))


@query()
def act_provisions(spark, d):
    pages = table(spark, d, "pages").select("page_id", F.concat(F.lit("<div id='rct_1'><p>(1) "), F.col("url"), F.lit("</p></div><div id='art_1'><p>1. One</p>"), "html", F.lit("<p>2. Two</p></div>")).alias("html"))
    return acts.split_act(pages, "page_id", "html").withColumn("text", F.md5("text"))


@query()
def html_blocks(spark, d):
    return acts.blocks(table(spark, d, "pages"), "page_id", "html").select("page_id", "n", F.md5("text").alias("text_md5"), F.size("classes").alias("classes"), F.array_join("ids", ",").alias("ids"))


@query("""select s_suppkey, case when s_suppkey % 5 = 0 then s_acctbal when s_suppkey % 5 = 1 then (100.0 + 500.0) / 2 when s_suppkey % 5 = 2 then 500.0 / 2 end as eur from supplier""")
def declared_cost(spark, d):
    k = F.col("s_suppkey") % 5
    text = lambda c: F.when(c, F.lit("500")).otherwise(F.lit(None))
    costs = F.struct(
        F.when(k == 4, "$").otherwise("€").alias("_currency"), F.when(k == 0, F.abs("s_acctbal").cast("string")).alias("absoluteCost"),
        F.struct(F.when((k == 1) | (k == 3), "100").alias("min"), F.when((k == 1) | (k == 2), "500").alias("max")).alias("range"),
    )
    eur = register.declared_cost(costs)["eur"]
    return table(spark, d, "supplier").select("s_suppkey", F.when(k == 0, F.when(F.col("s_acctbal") < 0, -eur).otherwise(eur)).otherwise(eur).alias("eur"))


@query("""select n_nationkey, case when n_nationkey % 3 = 2 then null else 'C' || n_regionkey end as country_code from nation""")
def country_codes(spark, d):
    countries = table(spark, d, "region").select(F.col("r_name").alias("name"), F.concat(F.lit("C"), F.col("r_regionkey").cast("string")).alias("code"))
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = n.select("n_nationkey", F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit(" "), F.lower("r_name"))).when(F.col("n_nationkey") % 3 == 1, F.concat(F.lit("C"), F.col("n_regionkey").cast("string"))).otherwise("?").alias("country"))
    return register.with_country(rows, "country", countries).select("n_nationkey", "country_code")


def _raw_feedback(spark, d):
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    return c.select(
        k.alias("id"), F.when(k % 3 == 0, "EU_CITIZEN").otherwise("COMPANY").alias("userType"), F.when(k % 4 == 0, "id 123456-78 and 654321-87").when(k % 4 == 1, " 123456-78 ").alias("trNumber"),
        F.concat(F.lit("COM(2021)0"), (k % 900 + 1).cast("string")).alias("referenceInitiative"), F.lit("EN").alias("language"), F.col("c_name").alias("feedback"), F.lit(None).cast("string").alias("feedbackTextUserLanguage"),
        F.when(k % 5 != 0, "2021/07/01 12:30:00").otherwise("yesterday").alias("dateFeedback"), F.lit(None).cast("string").alias("country"), F.lit(None).cast("string").alias("companySize"), F.col("c_mktsegment").alias("organization"),
        F.expr("cast(array() as array<struct<id:bigint,documentId:string,fileName:string>>)").alias("attachments"),
    )


@query("""select c_custkey as feedback_id, 'COM(2021)' || (c_custkey % 900 + 1) as com_reference, case when c_custkey % 5 <> 0 then '2021-07-01 10:30:00' end as submitted_at, case when c_custkey % 3 <> 0 then c_mktsegment end as organisation,
case when c_custkey % 3 <> 0 and c_custkey % 4 = 1 then '123456-78' end as register_id from customer""")
def feedback_rows(spark, d):
    rows = feedback.submissions(_raw_feedback(spark, d))
    return rows.select("feedback_id", "com_reference", F.date_format("submitted_at", "yyyy-MM-dd HH:mm:ss").alias("submitted_at"), "organisation", "register_id")


@query("""select distinct 'COM(' || year(o_orderdate) || ')' || (o_orderkey % 50 + 1) as com, o_custkey as initiative_id from orders where 'COM(' || year(o_orderdate) || ')' || (o_orderkey % 50 + 1) in ('COM(1996)7', 'COM(1997)8')""")
def find_initiatives(spark, d):
    text = F.concat(F.lit("COM("), F.year("o_orderdate").cast("string"), F.lit(") 00"), (F.col("o_orderkey") % 50 + 1).cast("string"))
    entries = table(spark, d, "orders").select(F.col("o_custkey").alias("initiative_id"), T.com_references(text).alias("com_references"))
    return feedback.find_initiatives(entries, spark.createDataFrame([("COM(1996)7",), ("COM(1997)8",)], "com string"))


@query("""select c_custkey, case when c_custkey % 5 = 0 then 'failed' when c_custkey % 5 = 1 then 'missing' when c_custkey % 5 = 2 then 'partial' when c_custkey % 5 = 3 then 'empty' else 'complete' end as status, case when c_custkey % 5 = 0 then 'broken' when c_custkey % 5 = 1 then 'absent' when c_custkey % 5 = 2 then 'a; b' end as reason from customer""")
def coverage_rows(spark, d):
    k = F.col("c_custkey") % 5
    none = F.lit(None).cast("string")
    s = acts.layer_status(F.when(k == 1, F.lit("absent")).otherwise(none), F.when(k == 0, F.lit("broken")).otherwise(none), F.when(k == 2, F.array(F.lit("a"), F.lit("b"))).otherwise(F.expr("cast(array() as array<string>)")), F.when(k == 3, 0).otherwise(5))
    return table(spark, d, "customer").select("c_custkey", s.alias("s")).select("c_custkey", "s.status", "s.reason")


@query("""select l_orderkey % 97 as procedure_id, case when count(distinct l_partkey % 3) = 1 then min('3' || l_partkey % 3) end as celex_final, count(distinct l_partkey % 3) > 1 as ambiguous from lineitem where l_linenumber < 7 group by all""")
def resolved_celex(spark, d):
    rows = table(spark, d, "lineitem").select((F.col("l_orderkey") % 97).alias("procedure_id"), F.concat(F.lit("3"), (F.col("l_partkey") % 3).cast("string"), F.when(F.col("l_linenumber") >= 7, "R(01)").otherwise("")).alias("celex"), F.lit("final").alias("role"))
    return acts.resolved_celex(rows).select("procedure_id", "celex_final", "ambiguous")


@query("""select o_custkey::varchar as celex, arg_min('h' || o_orderkey, o_orderkey) filter (o_orderkey % 3 <> 0) as act, coalesce(string_agg('h' || o_orderkey, ',' order by o_orderkey) filter (o_orderkey % 3 = 0), '') as annexes from orders group by o_custkey""")
def act_streams(spark, d):
    k = F.col("o_orderkey")
    listing = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("celex"), F.concat(F.lit("h"), k.cast("string")).alias("href"), F.when(k % 3 == 0, "2_EN_Annexe.html").otherwise("1_EN_act.html").alias("name"), k.alias("place"))
    return acts.act_streams(listing)


# --- Supporting operators -----------------------------------------------------------------


@query("""select doc_id, case when length(text) > 500000 then 'text_too_large' when trim(text) = '' then 'empty_document' end as code, case when length(text) <= 500000 and trim(text) <> '' then length(text) else -1 end as characters from documents""")
def extracted_text(spark, d):
    """With the limit that the operator has of itself."""
    rows = table(spark, d, "documents").select("doc_id", F.encode("text", "utf-8").alias("content"))
    return documents.extract_text(rows, "content").select("doc_id", "code", F.coalesce("characters", F.lit(-1)).alias("characters"))


@query("""select c_custkey, case c_custkey % 3 when 0 then 'stricter' when 1 then 'weaker' else 'unknown' end as direction, c_custkey % 3 = 2 as statement from customer""")
def ask_directions(spark, d):
    k = F.col("c_custkey") % 3
    text = F.when(k == 0, F.lit("Replace 'may be' with 'shall be' here")).when(k == 1, F.lit("please delete \"must\" now")).otherwise(F.concat(F.lit("We must not be required to "), F.col("c_name")))
    rows = table(spark, d, "customer").select("c_custkey", text.alias("text"))
    return S.with_direction(rows).select("c_custkey", "direction", (F.get("changes", F.lit(0))["kind"] == "statement").alias("statement"))


@query()
def asks(spark, d):
    found = S.asks(S.passage_rows(table(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("document_id"), "text")))
    return found.select("ask_id", "document_id", "direction", "limit_reason")


@query("""with p as (select distinct o_orderkey % 10000 as n from orders where o_orderkey % 7 <> 0)
select o_orderkey as query_id, case when n is null then 'unknown' else 'chosen' end as status, '2020/' || lpad(n::varchar, 4, '0') || '(COD)' as found from orders left join p on o_orderkey % 10000 = n""")
def resolve_law(spark, d):
    """All orders as dossiers and all as queries, those that lead nowhere too."""
    entries, _ = dump.catalog(dump.read_dump(dump.dump_lines(spark, _dossiers(spark, d).select("value")), dump.DOSSIER))
    k = F.col("o_orderkey")
    number = (k % 10000).cast("string")
    typed = F.when(k % 3 == 0, F.concat(F.lit("2020/"), number, F.lit(" cod"))).otherwise(F.concat(F.lit("com(2020) "), number))
    asked = table(spark, d, "orders").select(k.alias("query_id"), typed.alias("query"))
    return S.resolve_law(asked, entries, spark.createDataFrame([], "key string, title_id string"), U.caseless_key).select("query_id", "status", "found")


@query("""select o_orderpriority as code, count(*) || ' ' || o_orderpriority as line from orders group by o_orderpriority""")
def problem_counts(spark, d):
    return I.problem_counts(table(spark, d, "orders").select(F.col("o_orderpriority").alias("code")))


@query("""select s_suppkey, s_name || ' (g' || s_nationkey || ')' as label from supplier where s_suppkey % 2 = 0 union all select s_suppkey, 'm' || s_suppkey from supplier where s_suppkey % 2 = 1""")
def author_labels(spark, d):
    k = F.col("s_suppkey")
    none = F.expr("cast(array() as array<string>)")
    names, groups = F.when(k % 2 == 0, F.array("s_name")).otherwise(none), F.when(k % 2 == 0, F.array(F.concat(F.lit("g"), "s_nationkey"))).otherwise(none)
    return table(spark, d, "supplier").select("s_suppkey", F.array_join(T.author_labels(names, F.array(F.concat(F.lit("m"), k.cast("string"))), groups), "; ").alias("label"))


@query("""select distinct 'c' || l_partkey % 50 as celex, '2020/' || lpad((l_suppkey % 9999)::varchar, 4, '0') || '(COD)' as procedure_id from lineitem where l_linenumber <> 2 and l_partkey % 50 < 10""")
def procedures_for_celex(spark, d):
    rows = table(spark, d, "lineitem").select(F.concat(F.lit("c"), (F.col("l_partkey") % 50).cast("string")).alias("celex"), F.when(F.col("l_linenumber") != 2, F.concat(F.lit("2020/"), F.lpad((F.col("l_suppkey") % 9999).cast("string"), 4, "0"), F.lit("(COD)"))).otherwise("bad").alias("procedure_id"))
    return acts.procedures_for_celex(rows, spark.range(10).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("celex")))


@query(lineage_sql(_ORIGINS + """ select phrase_id, (select count(*) from carried c where c.phrase_id = p.phrase_id) as amendments, (select count(*) from origins o where o.phrase_id = p.phrase_id) as origins,
coalesce((select bool_or(eligibility = 'ask_first') from origins o where o.phrase_id = p.phrase_id), false) as asked_first from phrases p"""), True)
def prepared_phrases(spark, d):
    x = _lineage(spark, d)
    rows = I.prepared(x.phrases, x.carried, x.adoptions, x.origins)
    return rows.select("phrase_id", F.size("amendments").cast("long").alias("amendments"), F.size("origins").cast("long").alias("origins"), "asked_first")


@query("""select distinct source as organisation from documents where contains(lower(source), 'rc1')""")
def organisation_search(spark, d):
    return I.search_organisations(table(spark, d, "documents").select(F.col("source").alias("organisation")).distinct(), "RC1", 100)


@query(" select false as uses_latest", True)
def group_limitations(spark, d):
    return A.uses_latest_groups(_lineage(spark, d).authored)


@query("""select stage, count(*) as n from (select 'texts' as stage from documents where doc_id % 3 = 0 union all select 'asks' from documents where doc_id % 3 = 1 union all select 'amendments' from documents where doc_id % 3 = 2) group by stage""")
def stage_union(spark, d):
    t = table(spark, d, "documents")
    parts = {"texts": t.where("doc_id % 3 = 0"), "amendments": t.where("doc_id % 3 = 2"), "asks": t.where("doc_id % 3 = 1")}
    return store.union_stages(parts).groupBy("stage").agg(F.count(F.lit(1)).alias("n"))


@query("""with c as (select c_nationkey as publication, count(*) as n from customer group by c_nationkey)
select c_custkey // 100 as page, publication, c_custkey as feedback_id from customer join c on c_nationkey = publication where c_custkey // 100 <= n // 4""")
def feedback_pages(spark, d):
    """The last page follows from a publication's number of rows, of which a page has four on average."""
    rows = table(spark, d, "customer").select((F.col("c_custkey") / 100).cast("long").alias("page"), F.col("c_nationkey").alias("publication"), F.col("c_custkey").alias("feedback_id"))
    last = rows.groupBy("publication").agg(F.floor(F.count(F.lit(1)) / 4).alias("last_page"))
    return feedback.read_pages(rows, last)


@query("select doc_id, lang from documents where lang in ('en', 'fr')")
def consultation_documents(spark, d):
    """English and French stand for the two kinds that somebody submits."""
    kind = F.when(F.col("lang") == "en", "hys_feedback").when(F.col("lang") == "fr", "hys_attachment").otherwise("proposal")
    return O.consultation_only(table(spark, d, "documents").select("doc_id", "lang", kind.alias("source_kind"))).drop("source_kind")


@query("""select l_orderkey::varchar as amendment_id, l_linenumber, strftime(case when l_returnflag = 'N' then o_orderdate else l_shipdate end, '%Y-%m-%d') as tabled_on
from lineitem left join orders on o_orderkey = l_orderkey""")
def dated_adoptions(spark, d):
    """Lines stand for adoptions, those not returned for such without a day, and orders for their amendments."""
    own = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("amendment_id"), "l_linenumber", F.when(F.col("l_returnflag") != "N", F.to_date("l_shipdate")).alias("tabled_on"))
    amendments = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("amendment_id"), F.to_date("o_orderdate").alias("tabled_on"))
    return O.with_tabling_days(own, amendments).withColumn("tabled_on", day("tabled_on"))


@query("""select l_orderkey, l_linenumber, strftime(least(l_shipdate, o_orderdate), '%Y-%m-%d') as earlier, round(l_extendedprice / nullif(l_discount, 0), 6) as ratio from lineitem left join orders on o_orderkey = l_orderkey""")
def earlier_and_ratio(spark, d):
    """An order that is not there has no day, a line without discount nothing to divide by."""
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return rows.select("l_orderkey", "l_linenumber", F.date_format(I.earlier(F.col("l_shipdate"), F.col("o_orderdate")), "yyyy-MM-dd").alias("earlier"), F.round(I.ratio(F.col("l_extendedprice"), F.col("l_discount")), 6).alias("ratio"))


@query("select c_name as label, count(*) as phrases from customer join orders on o_custkey = c_custkey where contains(lower(c_name), 'r#0000000') group by c_name order by phrases desc, label limit 8")
def node_search(spark, d):
    nodes = table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey")).groupBy(F.col("c_name").alias("label")).agg(F.count(F.lit(1)).alias("phrases"))
    return I.find_nodes(nodes, " R#0000000 ")


@query("""select event_id, replace(event_type || '_read', '_', ' ') || case when user_id % 3 <> 0 then ' (' || user_id || ')' else '' end || case when value >= 1 then ': ' || props else '' end as line from events""")
def coverage_lines(spark, d):
    count, reason = F.when(F.col("user_id") % 3 != 0, F.col("user_id")), F.when(F.col("value") >= 1, F.col("props"))
    return table(spark, d, "events").select("event_id", I.coverage_line(F.concat("event_type", F.lit("_read")), count, reason).alias("line"))


@query("""select o_orderkey from orders where o_orderstatus = 'F' or (o_orderstatus = 'O' and year(o_orderdate) = 1997) or o_orderpriority = '1-URGENT'""")
def publications_of_law(spark, d):
    """Publications that name no reference, one of the year's, or two of which one is the law's."""
    own, other = F.concat(F.lit("see COM("), F.year("o_orderdate").cast("string"), F.lit(") 0012 final")), F.lit("COM(2003)7")
    text = F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("COM(2003)7 and COM(1997) 12")).when(F.col("o_orderstatus") == "F", F.lit("none")).when(F.col("o_orderstatus") == "O", own).otherwise(other)
    return table(spark, d, "orders").where(feedback.for_this_law(T.com_references(text), "COM(1997)12")).select("o_orderkey")


@query("""select s_suppkey as initiative_id, 'title' as found_by from supplier where s_acctbal < 0 and contains(lower(s_name), 'supplier#0')""")
def initiatives_by_title(spark, d):
    """No entry has the law's reference alone in the index, so words of the title propose and the reference decides."""
    coms = F.when(F.col("s_acctbal") < 0, F.array(F.lit("COM(2021)206"), F.lit("COM(2020)1"))).otherwise(F.array(F.lit("COM(2020)1")))
    entries = table(spark, d, "supplier").select(F.col("s_suppkey").alias("initiative_id"), F.col("s_name").alias("title"), coms.alias("com_references"))
    return feedback.find_by_title(entries, "SUPPLIER#0 artificial", "COM(2021)206").select("initiative_id", F.lit("title").alias("found_by"))


@query("""select s_suppkey as initiative_id, 'reference' as found_by from supplier where s_acctbal < 0""")
def initiatives(spark, d):
    """Where a reference is found, titles are not asked."""
    coms = F.when(F.col("s_acctbal") < 0, F.array(F.lit("COM(2020)1"), F.lit("COM(2021)206"))).otherwise(F.expr("cast(array() as array<string>)"))
    entries = table(spark, d, "supplier").select(F.col("s_suppkey").alias("initiative_id"), F.col("s_name").alias("title"), coms.alias("com_references"))
    return feedback.initiatives(entries, "COM(2021)206", "Supplier").select("initiative_id", "found_by")


@query("""with o as (select o_custkey, 'g' || o_orderpriority as g, strftime(o_orderdate, '%Y-%m-%d') as s, case when o_orderstatus <> 'O' then strftime(o_orderdate + interval 90 day, '%Y-%m-%d') end as e from orders)
select c_custkey as member_id, 'actor:mep:' || c_custkey as actor_id, c_name as name, arg_max(g, coalesce(e, '') || ' ' || s || ' ' || g) as latest_group, count(*) as n_spells, min(s) as first_start, max(e) as last_end
from customer join o on o_custkey = c_custkey where c_mktsegment = 'BUILDING' group by c_custkey, c_name""")
def member_spells(spark, d):
    """Customers stand for members, their orders for spells in groups; an open order's spell has no end."""
    start = F.date_format("o_orderdate", "yyyy-MM-dd")
    end = F.when(F.col("o_orderstatus") != "O", F.date_format(F.date_add("o_orderdate", 90), "yyyy-MM-dd"))
    spells = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list(F.struct(F.concat(F.lit("g"), "o_orderpriority").alias("groupid"), start.alias("start"), end.alias("end"))).alias("Groups"))
    none = F.expr("cast(array() as array<struct<country:string,start:string,end:string>>)")
    c = table(spark, d, "customer")
    records = c.join(spells, F.col("c_custkey") == F.col("o_custkey")).select(F.col("c_custkey").alias("UserID"), F.struct(F.col("c_name").alias("full")).alias("Name"), "Groups", none.alias("Constituencies"))
    found = dump.members(records, c.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("member_id")))
    days = lambda pick, name: pick(F.transform("spells", lambda x: x[name]))
    return found.select("member_id", "actor_id", "name", "latest_group", F.size("spells").cast("long").alias("n_spells"), F.date_format(days(F.array_min, "start"), "yyyy-MM-dd").alias("first_start"), F.date_format(days(F.array_max, "end"), "yyyy-MM-dd").alias("last_end"))


@query("""select 'actor:tr:' || lpad(s_suppkey::varchar, 6, '0') || '-12' as actor_id, s_name as name, case when n_regionkey < 3 then 'C' || n_regionkey else 'nowhere' end as country,
case when s_acctbal < 0 then 0.5 * round(-s_acctbal) else round(s_acctbal) end as eur, s_name || ',' || 'ß' || s_nationkey as aliases
from supplier join nation on n_nationkey = s_nationkey where s_acctbal not between 1000 and 3000""")
def register_actors(spark, d):
    """Suppliers as raw entries: some without a usable id; sums or bands without a floor; countries by name, or unknown."""
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    none, less = F.lit(None).cast("string"), F.col("s_acctbal") < 0
    key = F.concat(F.lit(" "), F.lpad(F.col("s_suppkey").cast("string"), 6, "0"), F.when(F.col("s_acctbal").between(1000, 3000), "/12").otherwise("-12"))
    amount = F.round(F.abs("s_acctbal")).cast("long").cast("string")
    costs = F.struct(F.lit("€").alias("_currency"), F.when(~less, amount).alias("absoluteCost"), F.struct(none.alias("min"), F.when(less, amount).alias("max")).alias("range"))
    raw = s.select(
        key.alias("identificationCode"), F.struct(F.concat("s_name", F.lit("  ")).alias("originalName"), F.concat(F.lit("ß"), F.col("s_nationkey").cast("string")).alias("nameInLatinAlphabet")).alias("name"), none.alias("acronym"), none.alias("registrationCategory"),
        none.alias("webSiteURL"), F.struct(F.when(F.col("n_regionkey") < 3, F.lower("r_name")).otherwise("nowhere").alias("country")).alias("headOffice"),
        F.struct(F.struct(costs.alias("costs"), F.struct(none.alias("absoluteCost")).alias("totalBudget")).alias("closedYear")).alias("financialData"),
    )
    countries = table(spark, d, "region").select(F.col("r_name").alias("name"), F.concat(F.lit("C"), F.col("r_regionkey").cast("string")).alias("code"))
    usable, _ = register.entries(raw, countries)
    actors = register.to_actors(usable).join(usable.select("register_id", F.col("declared_cost_eur").alias("eur")), "register_id")
    return actors.select("actor_id", "name", "country", "eur", F.array_join("aliases", ",").alias("aliases"))


@query("""select doc_id, strftime(make_date(2020, 1 + (length(text) % 12)::int, 1 + (length(text) % 28)::int), '%Y-%m-%d') as published_on from documents where lang <> 'en'""")
def printed_dates(spark, d):
    """Headers with a date after another block; English documents print none that is in the header's class."""
    n = F.length("text")
    date = F.concat_ws(".", (1 + n % 28).cast("string"), (1 + n % 12).cast("string"), F.lit("2020"))
    blocks = F.array(
        F.struct(F.lit(1).alias("n"), F.array(F.lit("oj-hd-ti")).alias("classes"), F.lit("Official Journal").alias("text")),
        F.struct(F.lit(2).alias("n"), F.array(F.when(F.col("lang") == "en", "other").otherwise(acts.DATE_CLASS)).alias("classes"), date.alias("text")),
        F.struct(F.lit(3).alias("n"), F.array(F.lit(acts.DATE_CLASS)).alias("classes"), F.lit("no date").alias("text")),
    )
    rows = table(spark, d, "documents").where("lang is not null").select("doc_id", F.inline(blocks))
    return acts.published_on(rows, "doc_id").withColumn("published_on", day("published_on"))
