"""Column functions over message, tool and document texts. Nothing here leaves the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrases, markers and character classes that decide results.
BOOTSTRAP = ["a new session was started via /new or /reset", "session startup sequence", "bootstrap.md"]
BOOTSTRAP_EXACT = "[Bootstrap pending]"
NEW_TASK = ["new task:", "/clear", "start over", "forget the previous", "新任务", "另一个任务", "重新开始"]
DONE = ["completed", "done", "fixed", "success", "resolved"]
DONE_EXACT = ["完成", "已修复", "搞定", "已完成", "解决了"]
CONCLUSION = ["结论", "总结", "综上", "总体而言", "综合来看", "最后", "总之", "conclusion", "in summary", "to summarize", "in conclusion", "overall"]
DECISIONS = [
    "(?iu)(I'll|I will|Let me|First,? I'll|我先|我将|让我先|接下来|首先)(.{5,320})",
    "(?iu)(I need to|I should|我需要|我应该|打算|计划)(.{5,320})",
    "(先|首先|接下来).{4,160}(查询|搜索|了解|收集|分析|检查|尝试|处理|实现|修复|编写|运行|调用)",
]
EXEC_NAMES = ["exec", "bash", "shell", "run_terminal_cmd"]
WEB_WORDS = ["curl", "wget", "search", "google", "bing", "http"]
PLATFORMS = [
    ("openclaw", ["openclaw", "open claw"]), ("hermes", ["hermes"]), ("claude_code", ["claude code", "claude-code"]), ("codex", ["codex", "openai codex"]),
    ("cursor", ["cursor agent", "cursor tab", "cursor"]), ("windsurf", ["windsurf", "cascade"]), ("copilot", ["github copilot", "copilot agent"]), ("aider", ["aider"]),
    ("cline", ["cline", "claude dev"]), ("gemini", ["gemini cli", "google gemini"]), ("chatgpt", ["chatgpt agent", "chatgpt"]),
]
PRESETS = ["sk-[A-Za-z0-9]{20,}", "AKIA[0-9A-Z]{16}", "ghp_[A-Za-z0-9]{20,}"]
COMMAND_WORDS = ["run_terminal_cmd", "bash", "shell", '"command"', "rm -rf", "rm -f", "rm -r", "sudo "]
API_WORDS = ['"function"', '"tool"', '"name":', "invoke(", "fetch(", "grpc", "rpc", "sdk", "runtime.", "read_file", "write("]
NETWORK_WORDS = ["curl ", "wget ", "web_fetch", "http.get", "https.get", "nc ", "http://", "https://"]
DELETE_WORDS = ["delete_file", "remove_file", "remove-item", "unlink", "rmdir", "shred", " trash ", '"rm ', " rm ", " rm-", "del /", 'del "', " rd /", "remove("]
DELETE_STARTS = ["rm ", "del ", "rd /"]
MODIFY_WORDS = ["write_file", "edit_file", "search_replace", "apply_patch", "create_file", "append_file", "sed -i", "chmod ", "chown ", "chattr ", " tee ", '"tee ', " mv ", '"mv ', " cp ", '"cp ', "move(", "rename(", " >> ", " > ", '>"']
ACCESS_WORDS = ["read_file", "list_dir", "glob_file_search", "file_search", "watch(", " cat ", '"cat ', "grep ", "head ", "tail ", "less ", "more ", "stat ", "open(", "readdir", "scandir", "pdftotext", "textutil", " find ", '"find ', " ls ", '"ls ', " ls-", '"ls-']
FALLBACK_STATUS = [401, 403, 404, 408, 415, 429, 500, 502, 503, 504]
CJK = "一-鿿㐀-䶿豈-﫿"
#: Scripts that fragments are compared by and that masking keeps, as ranges.
SCRIPT_CJK, SCRIPT_LATIN, SCRIPT_EURO = "一-鿿㐀-䶿぀-ヿ가-힯", "À-ɏ", "Ͱ-ӿ"
KEPT = f"0-9{SCRIPT_CJK}{SCRIPT_LATIN}{SCRIPT_EURO}"
#: What stands for each class; each belongs to its own class.
MASKS = [("[0-9]", "7"), ("[A-Z]", "X"), ("[a-z]", "x"), (f"[{SCRIPT_CJK}]", "某"), (f"[{SCRIPT_LATIN}]", "é"), (f"[{SCRIPT_EURO}]", "ж")]
MASK_OTHER = "ก"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def any_of(c: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(w) for w in words])


def truncate(c: Column, n: int) -> Column:
    """At most n code points, and an ellipsis where some are cut."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(c)


def is_bootstrap(c: Column) -> Column:
    return any_of(ascii_lower(c), BOOTSTRAP) | c.contains(BOOTSTRAP_EXACT)


def is_weak_goal(c: Column) -> Column:
    """A goal that a later real one replaces."""
    t = F.trim(c)
    return is_bootstrap(t) | ascii_lower(t).isin("unknown task", "openclaw") | t.startswith("You are ") | (F.length(t) < 8)


def keywords(c: Column) -> Column:
    """Distinct ASCII-lower-cased words of 3 bytes or more, and bigrams of the text's CJK characters alone."""
    words = F.filter(F.regexp_extract_all(ascii_lower(c), F.lit(r"([\p{L}\p{N}]+)"), 1), lambda w: F.octet_length(w) >= 3)
    cjk = F.regexp_replace(c, f"[^{CJK}]", "")
    pairs = F.when(F.length(cjk) >= 2, F.transform(F.sequence(F.lit(1), F.length(cjk) - 1), lambda i: F.substring(cjk, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(words, pairs))


def shared_of(a: Column, b: Column) -> tuple[Column, Column]:
    """Sizes of the intersection and the union of two keyword arrays."""
    return F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))


def related_goals(a: Column, b: Column, ka: Column, kb: Column) -> Column:
    """Equal, contained in one another, or with at least a quarter of all keywords in common; blanks and 'Unknown task' never."""
    x, y = F.trim(a), F.trim(b)
    both, either = shared_of(ka, kb)
    near = (F.size(ka) > 0) & (F.size(kb) > 0) & (both * 4 >= either)
    return ~x.isin("", "Unknown task") & ~y.isin("", "Unknown task") & (x.contains(y) | y.contains(x) | near)


def looks_like_new_task(text: Column, k_text: Column, k_goal: Column) -> Column:
    both, either = shared_of(k_text, k_goal)
    far = F.when((F.size(k_text) == 0) | (F.size(k_goal) == 0), F.lit(True)).otherwise(both * 100 < either * 12)
    return ~is_bootstrap(text) & (any_of(ascii_lower(text), NEW_TASK) | ((F.length(text) > 60) & far))


def looks_like_result(c: Column) -> Column:
    low = ascii_lower(c)
    least = F.when(c.contains("结论") | low.contains("conclusion"), 40).otherwise(80)
    return any_of(low, DONE) | any_of(c, DONE_EXACT) | (any_of(low, CONCLUSION) & (F.length(c) >= least))


def decision(c: Column) -> Column:
    """The first pattern's match of more than 8 bytes, cut at 320; null if there is none."""
    found = [F.trim(F.regexp_extract(c, p, 0)) for p in DECISIONS]
    return F.coalesce(*[F.when(F.octet_length(f) > 8, truncate(f, 320)) for f in found])


def tool_name(name: Column, args: Column) -> Column:
    n = ascii_lower(name)
    both = ascii_lower(F.concat_ws(" ", name, args))
    return F.when(n.isin(EXEC_NAMES), F.when(any_of(both, WEB_WORDS), "WebSearch").otherwise("Exec")).when(any_of(n, ["search", "web", "browse"]), "WebSearch").otherwise(name)


def tool_state(name: Column, args: Column) -> Column:
    n = ascii_lower(tool_name(name, args))
    return F.when(any_of(n, ["search", "web", "browse", "read", "grep", "list"]), "Information gathering").when(any_of(n, ["edit", "write", "patch"]), "Implementation").when(n.contains("test") | (n == "exec"), "Verification")


def platform(system: Column, tools: Column, header: Column, model: Column) -> Column:
    text = ascii_lower(F.concat_ws(" ", F.coalesce(system, F.lit("")), F.coalesce(header, F.lit("")), F.coalesce(model, F.lit(""))))
    joined = ascii_lower(F.array_join(tools, " "))
    out = F.when(any_of(text, PLATFORMS[0][1]), PLATFORMS[0][0])
    for name, marks in PLATFORMS[1:]:
        out = out.when(any_of(text, marks), name)
    out = out.when(F.exists(tools, lambda t: ascii_lower(t) == "exec") & ~any_of(joined, ["read", "edit", "apply_patch"]), "openclaw")
    return out.when(joined.contains("read") & any_of(joined, ["edit", "write", "bash"]), "claude_code").when(F.size(tools) == 0, "chat").otherwise("agent")


def agent_type(platform_id: Column, system: Column, tools: Column) -> Column:
    joined = ascii_lower(F.array_join(tools, " "))
    shell = F.exists(tools, lambda t: ascii_lower(t).isin("exec", "bash", "shell")) & ~any_of(joined, ["edit", "write"])
    coding = platform_id.isin("claude_code", "codex", "aider", "cline") | ascii_lower(system).contains("claude code") | (joined.contains("edit") & joined.contains("bash"))
    explore = any_of(joined, ["browser", "search", "web"]) | platform_id.isin("openclaw", "hermes") | shell
    return F.when(coding, "coding").when(explore, "explore").when(F.size(tools) == 0, "chat").otherwise("agent")


def capabilities(kind: Column, tools: Column) -> Column:
    j = ascii_lower(F.array_join(tools, " "))
    own = F.array(
        F.when(kind == "coding", "code_editing"), F.when(any_of(j, ["bash", "shell", "terminal"]), "shell_execution"), F.when(any_of(j, ["edit", "write", "file"]), "file_operations"),
        F.when(any_of(j, ["browser", "search", "web"]), "web_research"), F.when(j.contains("read"), "document_read"),
    )
    own = F.filter(own, lambda x: x.isNotNull())
    return F.array_sort(F.when(F.size(tools) == 0, F.array_union(own, F.array(F.lit("chat_only")))).when(F.size(own) == 0, F.array(F.lit("tool_use"))).otherwise(own))


def agent_fingerprint(system: Column, tools: Column) -> Column:
    """Sorted distinct lower-case tool names; without tools, the system text."""
    return F.when(F.size(tools) > 0, F.array_join(F.array_sort(F.array_distinct(F.transform(tools, ascii_lower))), ",")).otherwise(system)


def token_estimate(c: Column) -> Column:
    return F.regexp_count(c, F.lit("[A-Za-zÀ-ɏḀ-ỿ]+")) + F.regexp_count(c, F.lit(r"[^\sA-Za-zÀ-ɏḀ-ỿ]"))


def normalised(c: Column) -> Column:
    """Letters, ASCII digits and all signs of the listed scripts: what fragments are compared by."""
    return F.regexp_replace(c, rf"[^\p{{IsAlphabetic}}{KEPT}]", "")


def token_profile(c: Column) -> Column:
    """Distinct CJK characters, lower-case Latin words, and characters of other scripts, each sorted."""
    def distinct(x: Column, p: str) -> Column:
        return F.array_sort(F.array_distinct(F.regexp_extract_all(x, F.lit(f"({p})"), 0)))

    return F.struct(distinct(c, "[一-鿿㐀-䶿぀-ヿ가-힯]").alias("cjk"), distinct(F.lower(c), "[a-zà-ɏ]+").alias("latin"), distinct(c, "[Ͱ-ӿ]").alias("other"))


def quality_ok(c: Column) -> Column:
    """Whether extracted text is readable: length, letters, printable share, no document type line, no publisher XML."""
    t, low = F.trim(c), ascii_lower(F.trim(c))
    n = F.length(t)
    xml = low.contains("xmlns:") & any_of(low, ["elsevier", "schemas.openxmlformats"]) & (F.regexp_count(t, F.lit(r"(?=\p{L}{5})")) * 20 < n)
    doctype = low.contains("<!doctype") | (low.contains("doctype") & low.contains("html") & ~t.contains(" "))
    return (F.octet_length(t) >= 16) & (F.regexp_count(t, F.lit(r"[\p{L}\p{N}]")) * 10 >= n) & (F.floor(F.regexp_count(t, F.lit("[ -~\\t\\n\\r\\x0b\\x0c]")) * 100 / n) >= 75) & ~doctype & ~xml


def clean_path(c: Column) -> Column:
    """Slashes forward and single, no trailing one; drive letters and //server/share kept."""
    p = F.replace(F.trim(c), F.lit("\\"), F.lit("/"))
    one = F.regexp_replace(F.regexp_replace(p, "/+", "/"), "(?<=.)/$", "")
    return F.when(p.rlike("^//+[^/]+/+[^/]"), F.concat(F.lit("/"), one)).when(p.rlike("^[A-Za-z]:[^/]"), F.regexp_replace(one, "^([A-Za-z]:)", "$1/")).otherwise(one)


def intent(c: Column) -> Column:
    low = F.lower(c)
    delete = any_of(low, DELETE_WORDS) | reduce(lambda a, b: a | b, [low.startswith(x) for x in DELETE_STARTS])
    modify = any_of(low, MODIFY_WORDS) | (low.contains("echo ") & low.contains(">"))
    return F.when(delete, "delete").when(modify, "modify").when(any_of(low, ACCESS_WORDS) | low.startswith("ls "), "access").otherwise("unknown")


def strong_fragment(matched: Column, index: Column, hay: Column, least: int = 65, ratio: float = 0.5) -> Column:
    return (matched >= least) & ((matched > index * ratio) | (matched > hay * ratio) | (hay > least * 4))


def mask(c: Column) -> Column:
    """Each readable character by a fixed one of its class: digits, ASCII upper and lower case, CJK with kana and hangul, Latin
    with marks, Greek and Cyrillic, all other letters. Others stay, so lengths and classes do."""
    for pattern, sign in MASKS:
        c = F.regexp_replace(c, pattern, sign)
    return F.regexp_replace(c, rf"[\p{{IsAlphabetic}}&&[^A-Za-z{KEPT}]]", MASK_OTHER)
