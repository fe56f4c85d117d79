
from __future__ import annotations

import ast
import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tesserae.functions.text import as_col, clean_dashes, collapse, strip

# Phrases that signal a refusal or a disclaimer, matched in lower case in assistant turns.
REFUSALS = (
    "as an ai language model", "as a language model", "as a large language model", "as an ai,",
    "as an ai assistant", "as an artificial intelligence", "i'm an ai", "i am an ai",
    "an ai language model", "text-based ai", "i cannot fulfill", "i can't fulfill",
    "i cannot assist", "i can't assist", "i cannot help with", "i can't help with",
    "i'm unable to help", "i am unable to help", "i'm sorry, but i can", "i'm sorry, but i cannot",
    "i'm sorry, i can't", "i'm sorry, i cannot", "i apologize, but i can", "i apologize, but i cannot",
    "i cannot provide", "i can't provide", "i won't provide", "i will not provide",
    "not able to provide", "unable to provide", "against my programming", "my programming",
    "my guidelines", "ethical guidelines", "content policy", "usage policies", "i must decline",
    "i have to decline", "i'm not comfortable", "i am not comfortable", "i cannot engage",
    "i can't engage", "responsible ai", "prioritize safety", "prioritize user safety",
    "promote safety", "potentially harmful", "harmful or illegal", "illegal or harmful",
    "it is not appropriate", "it's not appropriate", "not appropriate for me", "i cannot condone",
    "i can't condone", "i do not condone", "i don't condone", "cannot support or promote",
    "my knowledge cutoff", "my knowledge cut off", "september 2021",
    "this chat conversation is shared from", "this conversation is shared from",
)
# Names of other assistants and their makers.
FOREIGN = r"\b(openai|chatgpt|gpt-?3\.5|gpt-?4o?|anthropic|smollm\d?|nous research|hermes[ -]?\d|qwen|tongyi|alibaba cloud|mistral ai|deepseek)\b|\b(i am|i'm|my name is) (claude|gemini|bard|llama|hermes|chatgpt)\b"
# The chat format's tokens.
BEGIN, HEAD, TAIL, END = "<|begin_of_text|>", "<|start_header_id|>", "<|end_header_id|>\n\n", "<|eot_id|>"
SYSTEM = "You are a helpful assistant. Answer directly and helpfully."


def mapped_role(role: Column) -> Column:
    """[F2]"""
    return F.when(role == "human", "user").when(role == "gpt", "assistant").otherwise(role)


def refuses(content: Column | str) -> Column:
    """[F3]"""
    low = F.lower(as_col(content))
    return F.exists(F.array(*map(F.lit, REFUSALS)), lambda p: F.contains(low, p))


def foreign(content: Column | str) -> Column:
    """[F4]"""
    return as_col(content).rlike("(?iuU)" + FOREIGN)


# Claims to be another assistant or another maker's.
CLAIM = r"\b(i am|i'm|my name is) (chatgpt|claude|gemini|bard|llama|qwen|deepseek|gpt)\b|\b(made|created|built|trained|developed) by (openai|anthropic|google|meta|alibaba|deepseek|microsoft)\b"
# Openers that deny or decline.
DENIAL = r"^\W*(no\b|nope\b|nah\b|i can't|i can’t|i cannot|i can not|i'm not\b|i’m not\b|i am not\b|i don't have|i don’t have|i do not have|unfortunately|sorry\b|i'm sorry|i’m sorry)"


def as_in_sql(pattern: str) -> str:
    """A pattern, without k and s in brackets, that ignores case and ends words as SQL's engine does: its \\b knows ASCII
    letters alone, so that a word ends before an accent, and k and s have one more letter each."""
    edge = "(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
    other = {r"\b": edge, r"\w": "[A-Za-z0-9_\u017f\u212a]", r"\W": "[^A-Za-z0-9_\u017f\u212a]", "k": "[k\u212a]", "s": "[s\u017f]"}
    return "(?i)" + re.sub(r"\\.|[ks]", lambda m: other.get(m[0], m[0]), pattern)


def claims(content: Column | str) -> Column:
    """A claim, also one that a denial takes back."""
    return as_col(content).rlike(as_in_sql(CLAIM))


def claims_foreign(content: Column | str) -> Column:
    """A claim that no denial in the same sentence, up to 40 characters before it, takes back."""
    return as_col(content).rlike(r"(?iuU)(?<!\b(?:not|never|isn't|wasn't|aren't|n't)\b[^.!?]{0,40})(?:" + CLAIM + ")")


def opens_with_denial(content: Column | str) -> Column:
    """[F13]"""
    return as_col(content).rlike(as_in_sql(DENIAL))


# Fixed value: a tool call in an assistant turn.
CALL = r"(?s)<tool_call>\s*(.*?)\s*</tool_call>"


def loose_value(s: str):
    """[S20] What JSON, or else a Python literal, stands for."""
    try:
        return json.loads(s)
    except ValueError:
        return ast.literal_eval(s)


def loose_json(s: str | None) -> str | None:
    """[S20] JSON as it is, and a Python literal as JSON; null for other text."""
    try:
        return json.dumps(loose_value(s), ensure_ascii=False)
    except Exception:
        return None


def loose(c: Column) -> Column:
    """[S20]"""
    return F.udf(loose_json, "string", useArrow=True)(c)


def plain_call(body: str) -> str:
    """A call as name and arguments only, in that order; the arguments keep theirs."""
    call = loose_value(body)
    return "<tool_call>\n" + json.dumps({"name": call["name"], "arguments": call.get("arguments", {})}, ensure_ascii=False) + "\n</tool_call>"


def plain_calls(roles: list | None, contents: list) -> list | None:
    """The contents with the calls of assistant turns rewritten; null where a call can't be read."""
    if roles is None:
        return None
    out = []
    for role, content in zip(roles, contents, strict=True):
        parts = re.split(CALL, content) if role == "assistant" and content else [content]
        try:
            out.append("".join(plain_call(x) if j % 2 else x for j, x in enumerate(parts)) if len(parts) > 1 else content)
        except Exception:
            out.append(None)
    return out


def with_plain_calls(messages: Column) -> Column:
    """(role, content, call_ok): the stripped messages with calls rewritten, as they are where one can't be read."""
    m = F.transform(messages, lambda x: F.struct(x["role"].alias("role"), F.coalesce(strip(x["content"]), F.lit("")).alias("content")))
    new = F.udf(plain_calls, "array<string>", useArrow=True)(F.transform(m, lambda x: x["role"]), F.transform(m, lambda x: x["content"]))
    return F.zip_with(m, new, lambda x, c: F.struct(x["role"].alias("role"), F.coalesce(c, x["content"]).alias("content"), c.isNotNull().alias("call_ok")))


def tool_rewritten(messages: Column | str, system: Column) -> Column:
    """The kept conversation: tool prompt first, each call as name and arguments only, tool results as flagged user
    turns. For rows whose tool_drop_reason is null."""
    turn = lambda m: F.struct(F.when(m["role"] == "tool", "user").otherwise(m["role"]).alias("role"), m["content"].alias("content"), (m["role"] == "tool").alias("tool"))
    first = F.struct(F.lit("system").alias("role"), system.alias("content"), F.lit(False).alias("tool"))
    return F.concat(F.array(first), F.transform(with_plain_calls(trimmed_to_reply(messages)), turn))


def cleaned(role: Column, content: Column) -> Column:
    """Empty thinking blocks and trailing thinking switches removed, ends trimmed."""
    c = F.when(role == "assistant", F.regexp_replace(content, r"<think>\s*</think>\s*", "")).when(role.isin("system", "user"), F.regexp_replace(content, r"\s*/(no_)?think\s*$", "")).otherwise(content)
    return strip(c)


def tidy(messages: Column | str) -> Column:
    """Roles mapped, contents cleaned, blank system messages left out."""
    named = F.transform(as_col(messages), lambda m: F.struct(mapped_role(m["role"]).alias("role"), cleaned(mapped_role(m["role"]), m["content"]).alias("content")))
    return F.filter(named, lambda m: ~((m["role"] == "system") & F.coalesce(m["content"] == "", F.lit(False))))


def body(messages: Column) -> Column:
    lead = F.coalesce(F.try_element_at(messages, F.lit(1))["role"] == "system", F.lit(False))
    return F.when(lead, F.slice(messages, F.lit(2), F.greatest(F.size(messages) - 1, F.lit(0)))).otherwise(messages)


def alternates(messages: Column) -> Column:
    """[W6] user, assistant, user, ..."""
    return F.forall(F.transform(messages, lambda m, i: m["role"] == F.when(i % 2 == 0, "user").otherwise("assistant")), lambda x: x)


def drop_reason(messages: Column | str, refusals: bool = True) -> Column:
    """The first reason to drop a conversation, or null. refusals=False is the policy of sources written to order [F7]."""
    raw = F.transform(as_col(messages), lambda m: F.struct(mapped_role(m["role"]).alias("role"), m["content"].alias("content")))
    first = lambda codes: F.try_element_at(F.filter(codes, lambda x: x.isNotNull()), F.lit(1))
    early = first(F.transform(raw, lambda m: F.when(~F.coalesce(m["role"].isin("system", "user", "assistant"), F.lit(False)), "drop_role").when(m["content"].isNull() | ((cleaned(m["role"], m["content"]) == "") & (m["role"] != "system")), "drop_empty")))
    out = tidy(messages)
    turns = body(out)
    broken = F.exists(turns, lambda m: m["role"] == "system") | (F.size(turns) < 2) | (F.size(turns) % 2 == 1) | ~alternates(turns)
    tools = F.exists(out, lambda m: m["content"].rlike("<think>|<tool_call>|<tools>"))
    says = lambda m: F.when((m["role"] == "assistant") & refuses(m["content"]), "drop_refusal") if refusals else F.lit(None).cast("string")
    late = first(F.transform(out, lambda m: F.coalesce(says(m), F.when(m["role"].isin("assistant", "system") & foreign(m["content"]), "drop_foreign_identity"))))
    return F.when(early.isNotNull(), early).when(broken, "drop_structure").when(tools, "drop_tools_think").otherwise(late)


def thinks_well(messages: Column | str) -> Column:
    """[F8] Every assistant turn opens with one thinking block and answers after it, without emoji, refusal or foreign name."""
    m = F.filter(as_col(messages), lambda x: x["role"] != "system")
    final = lambda c: F.lower(F.element_at(F.split(c, "</think>", 2), -1))
    good = lambda c: c.rlike(r"(?s)^\s*<think>.*?</think>\s*\S") & (F.size(F.split(c, "<think>")) == 2) & ~final(c).rlike("[\\x{1F000}-\\x{1FAFF}\\x{2600}-\\x{27BF}]") & ~refuses(final(c)) & ~foreign(c)
    return (F.size(m) >= 2) & (F.size(m) % 2 == 0) & alternates(m) & F.forall(m, lambda x: (strip(x["content"]) != "") & ((x["role"] != "assistant") | good(strip(x["content"]))))


def tools_of(xml: Column | str) -> Column:
    """The last non-empty <tools> block of a prompt."""
    blocks = F.filter(F.regexp_extract_all(as_col(xml), F.lit(r"(?s)<tools>\s*(.*?)\s*</tools>"), F.lit(1)), lambda x: strip(x) != "")
    return F.try_element_at(blocks, F.lit(-1))


def trimmed_to_reply(messages: Column | str) -> Column:
    """Without the turns after the last assistant turn, and without system turns."""
    m = F.filter(as_col(messages), lambda x: x["role"] != "system")
    last = F.array_max(F.transform(m, lambda x, i: F.when(x["role"] == "assistant", i + 1).otherwise(0)))
    return F.slice(m, F.lit(1), F.coalesce(last, F.lit(0)))


def tool_drop_reason(xml: Column | str, messages: Column | str) -> Column:
    """Why a tool conversation is dropped, or null: its tools, then the first reason by message, then its whole.

    Calls and tools are JSON or Python literals."""
    block = tools_of(xml)
    tools = F.try_parse_json(loose(block))
    listed = F.coalesce(F.schema_of_variant(tools).startswith("ARRAY") & F.try_variant_get(tools, "$[0]", "variant").isNotNull(), F.lit(False))
    m = with_plain_calls(trimmed_to_reply(messages))
    place = lambda x, i: F.when(i == 0, x["role"] == "user").when(i % 2 == 1, x["role"] == "assistant").otherwise(x["role"].isin("user", "tool"))
    own = lambda x: F.when(~x["call_ok"], "drop_bad_call_json").when(refuses(x["content"]), "drop_refusal").when(foreign(x["content"]), "drop_foreign_identity")
    reason = lambda x, i: F.when((x["content"] == "") | ~F.coalesce(place(x, i), F.lit(False)), "drop_structure").when(x["role"] == "assistant", own(x))
    first = F.try_element_at(F.filter(F.transform(m, reason), lambda x: x.isNotNull()), F.lit(1))
    short = (F.size(m) < 2) | F.exists(m, lambda x: F.contains(x["content"], F.lit("<think>")))
    return F.when(block.isNull(), "drop_no_tools").when(~listed, "drop_bad_tools_json").when(first.isNotNull(), first).when(short, "drop_structure")


def answers_directly(messages: Column | str) -> Column:
    """Whether a kept conversation offers tools and calls none; such are counted, not dropped."""
    return ~F.exists(as_col(messages), lambda m: (m["role"] == "assistant") & F.contains(m["content"], F.lit("<tool_call>")))


#: [F11] Which role may follow which in generated conversations.
FOLLOWS = {"": ("system", "user"), "system": ("user",), "user": ("assistant", "tool_call"), "tool_call": ("tool",), "tool": ("assistant", "tool_call"), "assistant": ("user",)}


def valid_transitions(messages: Column | str) -> Column:
    """Every role follows one that allows it, the last is the assistant, and no content is blank."""
    roles = F.transform(as_col(messages), lambda m: m["role"])
    before = F.concat(F.array(F.lit("")), roles)
    allowed = F.array(*(F.lit(f"{a}>{b}") for a, bs in FOLLOWS.items() for b in bs))
    steps = F.zip_with(F.slice(before, F.lit(1), F.size(roles)), roles, lambda a, b: F.concat(a, F.lit(">"), b))
    return (F.size(roles) > 0) & F.forall(steps, lambda s: F.array_contains(allowed, s)) & (F.element_at(roles, -1) == "assistant") & F.forall(as_col(messages), lambda m: F.coalesce(strip(m["content"]) != "", F.lit(False)))


# Which role may follow which where calls are in assistant turns.
GENERATED = ("user>assistant", "assistant>user", "assistant>tool", "tool>assistant")


def valid_generated(messages: Column | str, names: Column | None = None) -> Column:
    """A generated conversation with calls in assistant turns; `names` are those of the tools offered, if any.

    Roles follow each other as they may, from a user to an assistant turn; no content is blank. Assistant turns claim no
    other identity and don't think; their calls are JSON with a known name and an object of arguments. Tool turns need
    tools, follow a call and hold a response."""
    m = as_col(messages)
    known = F.coalesce(names, F.array().cast("array<string>")) if names is not None else F.array().cast("array<string>")
    call = lambda s: F.array_contains(known, F.try_variant_get(F.try_parse_json(s), "$.name", "string")) & F.schema_of_variant(F.try_variant_get(F.try_parse_json(s), "$.arguments", "variant")).startswith("OBJECT")
    calls = lambda c: F.regexp_extract_all(c, F.lit(CALL), F.lit(1))
    asks = lambda c: F.contains(c, F.lit("<tool_call>"))
    speaks = lambda c: ~claims_foreign(c) & ~F.contains(c, F.lit("<think>")) & (~asks(c) | ((F.size(known) > 0) & (F.size(calls(c)) > 0))) & F.forall(calls(c), lambda s: F.coalesce(call(s), F.lit(False)))
    own = lambda x: F.when(x["role"] == "assistant", speaks(x["content"])).when(x["role"] == "tool", (F.size(known) > 0) & F.contains(x["content"], F.lit("<tool_response>"))).otherwise(x["role"] == "user")
    step = lambda a, b: F.concat(a["role"], F.lit(">"), b["role"]).isin(*GENERATED) & ((b["role"] != "tool") | asks(a["content"]))
    steps = F.zip_with(F.slice(m, F.lit(1), F.greatest(F.size(m) - 1, F.lit(0))), F.slice(m, F.lit(2), F.greatest(F.size(m) - 1, F.lit(0))), step)
    fine = F.forall(m, lambda x: F.coalesce((strip(x["content"]) != "") & own(x), F.lit(False))) & F.forall(steps, lambda x: F.coalesce(x, F.lit(False)))
    return F.coalesce((F.size(m) >= 2) & (F.try_element_at(m, F.lit(1))["role"] == "user") & (F.try_element_at(m, F.lit(-1))["role"] == "assistant") & fine, F.lit(False))


def generated(messages: Column | str, names: Column | None = None) -> Column:
    """A generated conversation, cleaned, or null if it isn't valid: dashes become commas but in tool turns."""
    clean = F.transform(as_col(messages), lambda m: F.struct(m["role"].alias("role"), F.when(m["role"] == "tool", strip(m["content"])).otherwise(clean_dashes(m["content"])).alias("content")))
    return F.when(valid_generated(clean, names), clean)


#: System prompts that ask for thinking where a conversation has none of its own.
THINK_SYSTEMS = ("/think", SYSTEM + " /think", "Think step by step before answering. /think")


def thinking_row(messages: Column | str, own: Column, drawn: Column) -> Column:
    """[F8] A conversation that thinks_well, under a system prompt that asks for it: its own, unless that names another
    assistant, else one of THINK_SYSTEMS by a number drawn from 0 to 1. User turns lose a trailing switch."""
    mine = F.coalesce(strip(own), F.lit(""))
    system = F.when((mine != "") & ~foreign(mine), F.concat(mine, F.lit(" /think"))).otherwise(F.get(F.array(*map(F.lit, THINK_SYSTEMS)), F.floor(drawn * len(THINK_SYSTEMS)).cast("int")))
    bare = lambda c: strip(F.regexp_replace(c, r"\s*/(no_)?think\s*$", ""))
    said = lambda c: F.when(bare(c) == "", c).otherwise(bare(c))
    turns = F.transform(F.filter(as_col(messages), lambda m: m["role"] != "system"), lambda m: F.struct(m["role"].alias("role"), F.when(m["role"] == "user", said(strip(m["content"]))).otherwise(strip(m["content"])).alias("content")))
    return F.when(thinks_well(messages), F.concat(F.array(F.struct(F.lit("system").alias("role"), system.alias("content"))), turns))


#: [F9] Tokens of an example at most, and what a system prompt counts for.
MOST_TOKENS, SYSTEM_TOKENS = 8192, 20


def fits(tokens: Column | str, added: Column | None = None, most: int = MOST_TOKENS) -> Column:
    """Whether an example is short enough, also with a system prompt if one was added."""
    return as_col(tokens) + (F.when(added, SYSTEM_TOKENS).otherwise(0) if added is not None else 0) <= most


def opening_turns(messages: Column | str, least: int = 2, most: int = 4) -> Column:
    """The first user messages of a conversation that has at least two, else null."""
    asked = F.transform(F.filter(as_col(messages), lambda m: m["role"] == "user"), lambda m: m["content"])
    return F.when(F.size(asked) >= least, F.slice(asked, 1, most))


# An opening that denies, also in the middle of a first sentence, and what a model says of itself.
DENY = r"^\W*(no\b|nope\b|i can't|i can’t|i cannot|i'm not\b|i’m not\b|i am not\b|i don't have|sorry\b|i'm sorry)|^[^.\n]{0,80}, but i can't|\bI(?:'|’)m not (a|an|your) \w+"
SPEC = r"(?i)language model|1\.6 billion"


def denies(c: Column | str) -> Column:
    """[F13]"""
    return as_col(c).rlike(as_in_sql(DENY))


def names_itself(c: Column | str, names: str = SPEC) -> Column:
    """Whether a reply recites what the model is; a project adds its own names."""
    return as_col(c).rlike(names)


def first_user(messages: Column | str) -> Column:
    """[S13] The key of the first user message."""
    return collapse(F.try_element_at(F.filter(as_col(messages), lambda m: m["role"] == "user"), F.lit(1))["content"])


def header(role: Column) -> Column:
    return F.concat(F.lit(HEAD), role, F.lit(TAIL))


def rendered(messages: Column | str) -> Column:
    """[S14] The training format, with the begin token before the first message."""
    return F.array_join(F.transform(as_col(messages), lambda m, i: F.concat(F.when(i == 0, BEGIN).otherwise(""), header(m["role"]), F.trim(m["content"]), F.lit(END))), "")


def rendered_flagged(messages: Column | str, generate: bool = False) -> Column:
    """[S14] The same for messages (role, content, tool): a flagged turn's header is `tool`. generate: with the header of
    a reply to come, for inference."""
    whole = F.array_join(F.transform(as_col(messages), lambda m, i: F.concat(F.when(i == 0, BEGIN).otherwise(""), header(F.when(F.coalesce(m["tool"], F.lit(False)), "tool").otherwise(m["role"])), F.trim(m["content"]), F.lit(END))), "")
    return F.concat(whole, header(F.lit("assistant"))) if generate else whole


def packed_history(messages: Column | str) -> Column:
    """[S15] All messages as one user message, with literal turn tokens between them."""
    return F.array_join(F.transform(as_col(messages), lambda m, i: F.concat(F.when(i == 0, F.lit("")).otherwise(F.concat(F.lit(END), header(m["role"]))), m["content"])), "")
