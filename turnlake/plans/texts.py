"""Column functions over conversations, documents and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnlake.functions import text as T
from turnlake.registry import query
from turnlake.sources.tables import events, read, turns

AL = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
KW = "list_distinct(list_concat(list_filter(regexp_extract_all(" + AL + r", '[\p{{L}}\p{{N}}]+'), lambda w: strlen(w) >= 3), []))"


def _like(col: str, words: list[str]) -> str:
    return "(" + " or ".join(f"contains({col}, '{w.replace(chr(39), chr(39) * 2)}')" for w in words) + ")"


@query("fn13_token_estimate", r"""select doc_id, cast(len(regexp_extract_all(text, '[A-Za-zÀ-ɏḀ-ỿ]+')) + len(regexp_extract_all(text, '[^\sA-Za-zÀ-ɏḀ-ỿ]')) as bigint) tokens from documents""")
def fn13(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.token_estimate(F.col("text")).cast("long").alias("tokens"))


PAIRS = f"with p as (select conv_id, turn, {KW.format('text')} a, lead({KW.format('text')}) over (partition by conv_id order by turn) b from conversations)"


@query("fn11_fn12_so1_keyword_jaccard", f"{PAIRS} select conv_id, turn, cast(len(list_intersect(a, b)) as bigint) shared, cast(len(list_distinct(list_concat(a, b))) as bigint) either, (len(a) > 0 and len(b) > 0 and len(list_intersect(a, b)) * 4 >= len(list_distinct(list_concat(a, b)))) near from p where b is not null")
def fn12(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    p = turns(spark, sf_dir).withColumn("a", T.keywords(F.col("text"))).withColumn("b", F.lead("a").over(w)).where("b is not null")
    both, either = T.shared_of(F.col("a"), F.col("b"))
    return p.select("conv_id", "turn", both.cast("long").alias("shared"), either.cast("long").alias("either"), ((F.size("a") > 0) & (F.size("b") > 0) & (both * 4 >= either)).alias("near"))


PLANTED = ["A new session was started via /new or /reset. Go.", "You are a helper", "fix", "please read [Bootstrap pending] now", "Unknown task", "real work to be done here"]
_PLANT = "case conv_id % 8 " + " ".join(f"when {k} then '{p}'" for k, p in enumerate(PLANTED)) + " else text end"


@query("pf11_weak_goals", f"""with p as (select conv_id, turn, {_PLANT} t from conversations), b as (select *, ({_like(AL.format('t'), T.BOOTSTRAP)} or contains(t, '{T.BOOTSTRAP_EXACT}')) boot from p)
select conv_id, turn, boot, (boot or {AL.format('trim(t)')} in ('unknown task', 'openclaw') or starts_with(trim(t), 'You are ') or length(trim(t)) < 8) weak from b""")
def pf11(spark, sf_dir):
    t = F.expr(_PLANT)
    return turns(spark, sf_dir).select("conv_id", "turn", T.is_bootstrap(t).alias("boot"), T.is_weak_goal(t).alias("weak"))


@query("pf12_new_task", PAIRS.replace("conv_id, turn,", "conv_id, turn, text t,", 1) + f""" select conv_id, turn, (not {_like(AL.format('t'), T.BOOTSTRAP)} and not contains(t, '{T.BOOTSTRAP_EXACT}') and ({_like(AL.format('t'), T.NEW_TASK)} or (length(t) > 60 and
  (len(a) = 0 or len(b) = 0 or len(list_intersect(a, b)) * 100 < len(list_distinct(list_concat(a, b))) * 12)))) fresh from p where b is not null""")
def pf12(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    p = turns(spark, sf_dir).withColumn("a", T.keywords(F.col("text"))).withColumn("b", F.lead("a").over(w)).where("b is not null")
    return p.select("conv_id", "turn", T.looks_like_new_task(F.col("text"), F.col("a"), F.col("b")).alias("fresh"))


@query("pf13_results", f"""select conv_id, turn, ({_like(AL.format('text'), T.DONE)} or {_like('text', T.DONE_EXACT)} or ({_like(AL.format('text'), T.CONCLUSION)} and length(text) >= case when contains(text, '结论') or contains({AL.format('text')}, 'conclusion') then 40 else 80 end)) done from conversations""")
def pf13(spark, sf_dir):
    return turns(spark, sf_dir).select("conv_id", "turn", T.looks_like_result(F.col("text")).alias("done"))


_SAY = "case turn % 4 when 0 then 'I''ll ' when 1 then 'We should. I need to ' when 2 then '我先 看看 ' else '' end || text"
_DEC = [d.replace("(?iu)", "(?i)").replace("'", "''") for d in T.DECISIONS]


@query("fn8_decisions", f"""with s as (select conv_id, turn, {_SAY} t from conversations), m as (select *, {', '.join(f"trim(regexp_extract(t, '{d}', 0)) m{k}" for k, d in enumerate(_DEC))} from s),
f as (select *, case when strlen(m0) > 8 then m0 when strlen(m1) > 8 then m1 when strlen(m2) > 8 then m2 end d from m) select conv_id, turn, case when length(d) > 320 then left(d, 320) || '…' else d end decision from f""")
def fn8(spark, sf_dir):
    return turns(spark, sf_dir).select("conv_id", "turn", T.decision(F.expr(_SAY.replace("I''ll", "I\\'ll"))).alias("decision"))


@query("fn7_truncation", "select doc_id, case when length(text) > 240 then left(text, 240) || '…' else text end short from documents")
def fn7(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.truncate(F.col("text"), 240).alias("short"))


#: The same for DuckDB, whose expressions know no alphabetic property.
NORM = rf"regexp_replace({{}}, '[^\p{{{{L}}}}\p{{{{Nl}}}}{T.KEPT}]', '', 'g')"
#: A line of every script, so that each class is met.
_SCRIPTS = "text || ' かな カタカナ ー 한글 مرحبا שלום ไทย Ωμέγα Жук × ÷ ß Ł ª ' || cast(doc_id as {})"


@query("fn17_normalised_text", f"select doc_id, md5({NORM.format(_SCRIPTS.format('varchar'))}) norm from documents")
def fn17(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(T.normalised(F.expr(_SCRIPTS.format("string")))).alias("norm"))


@query("ag15_token_profiles", r"select doc_id, md5(array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '[a-zà-ɏ]+'))), ',')) latin, cast(len(list_distinct(regexp_extract_all(text, '[一-鿿㐀-䶿぀-ヿ가-힯]'))) as bigint) cjk from documents")
def ag15(spark, sf_dir):
    p = T.token_profile(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(F.array_join(p["latin"], ",")).alias("latin"), F.size(p["cjk"]).cast("long").alias("cjk"))


@query("sc8_quality_gate", r"""with t as (select page_id, trim(html) t, length(trim(html)) n from pages) select page_id, (strlen(t) >= 16 and len(regexp_extract_all(t, '[\p{L}\p{N}]')) * 10 >= n and (len(regexp_extract_all(t, '[ -~\t\n\r\x0b\x0c]')) * 100) // n >= 75
  and not contains(lower(t), '<!doctype')) fine from t""")
def sc8(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", T.quality_ok(F.col("html")).alias("fine"))


_SECRET = "case doc_id % 4 when 0 then ' sk-' || repeat('a1', 12) when 1 then ' AKIA' || repeat('Z9', 8) when 2 then ' ghp_' || repeat('q', 25) else '' end"
_WITH_SECRET = f"text || {_SECRET}"


@query("fn24_preset_secrets", f"select doc_id, regexp_replace({_WITH_SECRET}, '{'|'.join(T.PRESETS)}', '[secret]', 'g') redacted, regexp_matches({_WITH_SECRET}, '{'|'.join(T.PRESETS)}') hit from documents")
def fn24(spark, sf_dir):
    t = F.expr(_WITH_SECRET)
    return read(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(t, "|".join(T.PRESETS), "[secret]").alias("redacted"), t.rlike("|".join(T.PRESETS)).alias("hit"))


_MASKED = _SCRIPTS.format("varchar")
for _p, _m in T.MASKS:
    _MASKED = f"regexp_replace({_MASKED}, '{_p}', '{_m}', 'g')"


@query("fn23_class_masking", rf"select doc_id, regexp_replace({_MASKED}, '[^\P{{L}}A-Za-z{T.KEPT}]', '{T.MASK_OTHER}', 'g') masked from documents")
def fn23(spark, sf_dir):
    """Deterministic masking of each class; lengths stay."""
    return read(spark, sf_dir, "documents").select("doc_id", T.mask(F.expr(_SCRIPTS.format("string"))).alias("masked"))


@query("fn25_vault_tokens", """with s as (select event_id, user_id, event_type || '-' || cast(floor(value) as bigint) % 5 secret, row_number() over (partition by user_id order by ts, event_id) n from events),
f as (select user_id, secret, min(n) first from s group by 1, 2), v as (select *, dense_rank() over (partition by user_id order by first) - 1 k from f) select event_id, case when k < 4096 then '[[' || lpad(cast(k as varchar), 8, '0') || ']]' else '***' end token from s join v using (user_id, secret)""")
def fn25(spark, sf_dir):
    """A stable placeholder for each distinct secret of a session, by first use; beyond 4096 it can't be undone."""
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    s = events(spark, sf_dir).select("event_id", "user_id", F.concat_ws("-", "event_type", (F.floor("value") % 5).cast("string")).alias("secret"), F.row_number().over(w).alias("n"))
    first = F.min("n").over(Window.partitionBy("user_id", "secret"))
    k = F.dense_rank().over(Window.partitionBy("user_id").orderBy("first")) - 1
    s = s.withColumn("first", first).withColumn("k", k)
    return s.select("event_id", F.when(F.col("k") < 4096, F.concat(F.lit("[["), F.lpad(F.col("k").cast("string"), 8, "0"), F.lit("]]"))).otherwise("***").alias("token"))


_PATHS = ["'C:\\\\Users\\\\' || cast(page_id as string) || '\\\\f.txt'", "'//srv//share///' || cast(page_id as string) || '/'", "'/a//b/' || cast(page_id as string) || '//'", "'rel/./x' || cast(page_id as string)", "'D:'", "'  /tmp/q ' "]
_PATH = "case page_id % 6 " + " ".join(f"when {k} then {p}" for k, p in enumerate(_PATHS)) + " end"


@query("fn27_clean_paths", """select page_id, case page_id % 6 when 0 then 'C:/Users/' || page_id || '/f.txt' when 1 then '//srv/share/' || page_id when 2 then '/a/b/' || page_id when 3 then 'rel/./x' || page_id when 4 then 'D:' else '/tmp/q' end path from pages""")
def fn27(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", T.clean_path(F.expr(_PATH)).alias("path"))


@query("fn36_short_ids", "select o_orderkey, case when strlen(o_orderpriority || o_orderkey) > 8 then right(o_orderpriority || o_orderkey, 6) else o_orderpriority || o_orderkey end short from orders")
def fn36(spark, sf_dir):
    t = F.concat("o_orderpriority", F.col("o_orderkey").cast("string"))
    return read(spark, sf_dir, "orders").select("o_orderkey", F.when(F.octet_length(t) > 8, F.right(t, F.lit(6))).otherwise(t).alias("short"))


@query("fn38_json_salvage", r"select event_id, regexp_extract('Sure: ' || props || ' ok } tail', '(?s)\{.*\}', 0) salvaged from events")
def fn38(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.regexp_extract(F.concat(F.lit("Sure: "), "props", F.lit(" ok } tail")), r"(?s)\{.*\}", 0).alias("salvaged"))


@query("fn43_event_lines", "select event_id, '#' || event_id || ' [' || event_type || '] ' || props line from events")
def fn43(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.format_string("#%d [%s] %s", "event_id", "event_type", "props").alias("line"))


@query("fn45_audit_summaries", """select l_orderkey, 'Protocol: ' || max(l_linestatus) || ' | Fallback: ' || string_agg(cast(l_partkey as varchar), ' → ' order by l_linenumber, l_partkey) || ' | DLP: ' || count(*) || ' | Safety: ' || count(*) filter (where l_returnflag = 'R') || ' blocked, ' || count(*) filter (where l_returnflag = 'A') || ' observed | '
  || case when count(*) filter (where l_returnflag = 'N') > 0 then 'OK' else 'FAILED' end line from lineitem group by 1""")
def fn45(spark, sf_dir):
    a = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.max("l_linestatus").alias("protocol"), F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("chain"), F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("l_returnflag") == "R").alias("blocks"), F.count_if(F.col("l_returnflag") == "A").alias("seen"), F.count_if(F.col("l_returnflag") == "N").alias("good"))
    chain = F.array_join(F.transform("chain", lambda s: s["l_partkey"].cast("string")), " → ")
    return a.select("l_orderkey", F.format_string("Protocol: %s | Fallback: %s | DLP: %d | Safety: %d blocked, %d observed | %s", "protocol", chain, "n", "blocks", "seen", F.when(F.col("good") > 0, "OK").otherwise("FAILED")).alias("line"))


@query("fn20_fragment_thresholds", "select l_orderkey, l_linenumber, (l_quantity >= 20 and (l_quantity > l_tax * 500 or l_quantity > l_discount * 500 or l_discount * 1000 > 80)) strong from lineitem")
def fn20(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", T.strong_fragment(F.col("l_quantity"), F.col("l_tax") * 1000, F.col("l_discount") * 1000, 20, 0.5).alias("strong"))


_TOOLSETS = [["Read", "Edit", "Bash"], ["exec"], ["web_search", "fetch"], [], ["Shell"], ["Notes"]]
_TOOLS = "case event_id % 6 " + " ".join(f"when {k} then array({', '.join(repr(x) for x in t)})" for k, t in enumerate(_TOOLSETS) if t) + " else cast(array() as array<string>) end"
_SYS = "case event_id % 5 when 0 then 'You run in Cursor Agent' when 1 then 'hermes says' when 2 then '' else 'plain' end"


@query("fn2_to_fn5_agent_identity", """with t as (select event_id, case event_id % 6 when 0 then 'bash,edit,read' when 1 then 'exec' when 2 then 'fetch,web_search' when 4 then 'shell' when 5 then 'notes' else '' end tl,
  case event_id % 5 when 0 then 'You run in Cursor Agent' when 1 then 'hermes says' when 2 then '' else 'plain' end s from events),
p as (select *, case when s = 'You run in Cursor Agent' then 'cursor' when s = 'hermes says' then 'hermes' when tl = 'exec' then 'openclaw' when tl = 'bash,edit,read' then 'claude_code' when tl = '' then 'chat' else 'agent' end pl from t),
k as (select *, case when pl = 'claude_code' or tl = 'bash,edit,read' then 'coding' when tl in ('fetch,web_search', 'exec', 'shell') or pl in ('openclaw', 'hermes') then 'explore' when tl = '' then 'chat' else 'agent' end kind from p)
select event_id, case when tl <> '' then tl else s end fingerprint, pl platform, kind, case when tl = 'bash,edit,read' then 'code_editing,document_read,file_operations,shell_execution' when tl = 'shell' then 'shell_execution' when tl = 'fetch,web_search' then 'web_research' when tl = '' then 'chat_only' else 'tool_use' end caps from k""")
def fn2(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", F.expr(_TOOLS).alias("tools"), F.expr(_SYS).alias("system"))
    none = F.lit(None).cast("string")
    e = e.withColumn("platform", T.platform(F.col("system"), F.col("tools"), none, none))
    e = e.withColumn("kind", T.agent_type(F.col("platform"), F.col("system"), F.col("tools")))
    return e.select("event_id", T.agent_fingerprint(F.col("system"), F.col("tools")).alias("fingerprint"), "platform", "kind", F.array_join(T.capabilities(F.col("kind"), F.col("tools")), ",").alias("caps"))


_CALL = "case event_id % 5 when 0 then 'exec' when 1 then 'web_fetch' when 2 then 'Edit' when 3 then 'run_tests' else 'bash' end"
_ARGS = "case event_id % 3 when 0 then 'curl http://x' else 'ls -la' end"


@query("fn9_fn10_tool_names_states", f"""with c as (select event_id, {_CALL} n, {_ARGS} a from events), t as (select *, case when n in ('exec', 'bash') then case when a like 'curl%' then 'WebSearch' else 'Exec' end when n = 'web_fetch' then 'WebSearch' else n end tool from c)
select event_id, tool, case when tool = 'WebSearch' then 'Information gathering' when tool = 'Edit' then 'Implementation' when tool in ('Exec', 'run_tests') then 'Verification' end state from t""")
def fn9(spark, sf_dir):
    n, a = F.expr(_CALL), F.expr(_ARGS)
    return read(spark, sf_dir, "events").select("event_id", T.tool_name(n, a).alias("tool"), T.tool_state(n, a).alias("state"))
