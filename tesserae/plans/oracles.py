"""The SQL that each query must equal, for DuckDB on the same tables."""

from __future__ import annotations

# Fixed values, stated here once more: what a query must use is not taken from what it uses.
REFUSALS = (
    'as an ai language model', 'as a language model', 'as a large language model', 'as an ai,', 'as an ai assistant',
    'as an artificial intelligence', "i'm an ai", 'i am an ai', 'an ai language model', 'text-based ai',
    'i cannot fulfill', "i can't fulfill", 'i cannot assist', "i can't assist", 'i cannot help with',
    "i can't help with", "i'm unable to help", 'i am unable to help', "i'm sorry, but i can",
    "i'm sorry, but i cannot", "i'm sorry, i can't", "i'm sorry, i cannot", 'i apologize, but i can',
    'i apologize, but i cannot', 'i cannot provide', "i can't provide", "i won't provide", 'i will not provide',
    'not able to provide', 'unable to provide', 'against my programming', 'my programming', 'my guidelines',
    'ethical guidelines', 'content policy', 'usage policies', 'i must decline', 'i have to decline',
    "i'm not comfortable", 'i am not comfortable', 'i cannot engage', "i can't engage", 'responsible ai',
    'prioritize safety', 'prioritize user safety', 'promote safety', 'potentially harmful', 'harmful or illegal',
    'illegal or harmful', 'it is not appropriate', "it's not appropriate", 'not appropriate for me',
    'i cannot condone', "i can't condone", 'i do not condone', "i don't condone", 'cannot support or promote',
    'my knowledge cutoff', 'my knowledge cut off', 'september 2021', 'this chat conversation is shared from',
    'this conversation is shared from',
)
STOP = (
    'that', 'this', 'with', 'from', 'have', 'were', 'been', 'their', 'which', 'would', 'there', 'could', 'other',
    'these', 'those', 'about', 'after', 'before', 'where', 'when', 'what', 'while', 'into', 'than', 'then', 'them',
    'they', 'your', 'some', 'such', 'only', 'also', 'more', 'most', 'over', 'under', 'between', 'through', 'because',
    'during', 'each', 'both', 'being', 'within', 'without', 'against', 'using', 'used', 'based', 'shown', 'figure',
    'table', 'data', 'results', 'study', 'studies', 'however', 'therefore', 'thus', 'given', 'since', 'among', 'upon',
    'very', 'much', 'many', 'said', 'will', 'shall', 'must', 'might', 'should', 'like', 'just', 'even', 'still',
    'well', 'made', 'make', 'does', 'done', 'here', 'have', 'having', 'were',
)
TOPICS = (
    'harbour', 'orchard', 'lighthouse', 'foundry', 'archive', 'greenhouse', 'quarry', 'mill',
)
HEADS = (
    'Brel', 'Quor', 'Vint', 'Sarn', 'Oxal', 'Temb',
)
MIDS = (
    'a', 'o', 'iri', 'u',
)
TAILS = (
    'dex', 'mora', 'fane', 'tilo', 'grith',
)
FOREIGN = r"(?i)\b(openai|chatgpt|gpt-?3\.5|gpt-?4o?|anthropic|smollm\d?|nous research|hermes[ -]?\d|qwen|tongyi|alibaba cloud|mistral ai|deepseek)\b|\b(i am|i'm|my name is) (claude|gemini|bard|llama|hermes|chatgpt)\b"
CLAIM = r"(?i)\b(i am|i'm|my name is) (chatgpt|claude|gemini|bard|llama|qwen|deepseek|gpt)\b|\b(made|created|built|trained|developed) by (openai|anthropic|google|meta|alibaba|deepseek|microsoft)\b"
DENIAL = r"(?i)^\W*(no\b|nope\b|nah\b|i can't|i can’t|i cannot|i can not|i'm not\b|i’m not\b|i am not\b|i don't have|i don’t have|i do not have|unfortunately|sorry\b|i'm sorry|i’m sorry)"
ABSTAIN = r"(?i)\b(i don'?t (know|have)|i do not (know|have)|i'?m not (sure|familiar|aware)|i am not (sure|familiar|aware)|not familiar with|no (reliable )?(information|data|record)|can'?t (confirm|verify|find)|cannot (confirm|verify|find)|couldn'?t find|could you (clarify|provide)|not enough information)\b"
ACCEPT = r"(?i)you'?re right|you are right|my mistake|i was wrong|i got (that|it) wrong|i had (that|it) wrong|good catch|thanks for|thank you for|i stand corrected|apolog|my error|i made (a|an) (mistake|error)|correction"
EXACT = r"(?i)spell|letter|typo|gramm|proofread|correct|fix|edit|translat|rewrit|rephras|anagram|palindrom|rhym|count|regex|password|synonym|acronym|abbrev|pronounc|what does .* mean|meaning of|define|definition|word"
WS = r"[ \t\n\r\f\v]"


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def norm(c: str) -> str:
    return f"trim(regexp_replace(translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g'))"


def strip(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def uniform(key: str, seed: str) -> str:
    return f"(('0x' || substr(md5('{seed}:' || {key}), 1, 13))::BIGINT / 4503599627370496.0)"


def md5_mod(c: str, n: int) -> str:
    h = f"md5({c}::VARCHAR)"
    out = "0"
    for k in range(8):
        out = f"(({out}) * 65536 + ('0x' || substr({h}, {4 * k + 1}, 4))::BIGINT) % {n}"
    return out


def drawn(names: tuple[str, ...], key: str, seed: str) -> str:
    return f"[{', '.join(map(quoted, names))}][floor({uniform(key, seed)} * {len(names)})::INT + 1]"


TOKENS = r"len(regexp_extract_all(text, '[A-Za-z0-9]+|[^A-Za-z0-9 \t\n\r\f\v]'))"


def probes(bench: str) -> str:
    return f"""items AS (SELECT {bench} AS bench, item_id AS id, {norm("text")} AS n FROM benchmark),
probes AS (SELECT bench, id, 0 AS k, CASE WHEN length(n) < 160 THEN n ELSE trim(substr(n, 1, 80)) END AS pat FROM items WHERE length(n) >= 50
  UNION ALL SELECT bench, id, 1, trim(right(n, 80)) FROM items WHERE length(n) >= 160),
texts AS (SELECT doc_id, source, {norm("text")} AS n FROM documents),
hits AS (SELECT DISTINCT doc_id, source, bench, id, k, pat, n FROM texts, probes WHERE contains(n, pat))"""


PROBES = probes("'benchmark'")
BENCHES = probes("['gsm8k', 'mmlu', 'humaneval_solution'][item_id % 3 + 1]")
PLACES = f"""{BENCHES}, occ AS (SELECT *, unnest(list_filter(range(1, length(n) - length(pat) + 2), lambda i: substr(n, i, length(pat)) = pat)) + length(pat) - 2 AS e FROM hits)"""
HIT_ROWS = f"WITH {PROBES} SELECT doc_id, id AS item_id, k FROM hits"
ROLE = "CASE role WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' ELSE role END"
CHAT = f"""raw AS (SELECT conv_id, turn, {ROLE} AS role, text FROM conversations),
clean AS (SELECT conv_id, turn, role, text, {strip(r"CASE role WHEN 'assistant' THEN regexp_replace(text, '<think>\s*</think>\s*', '', 'g') ELSE regexp_replace(text, '\s*/(no_)?think\s*$', '') END")} AS c FROM raw),
kept AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM clean WHERE NOT (role = 'system' AND coalesce(c = '', false))),
lead AS (SELECT *, i - max(CASE WHEN i = 1 AND role = 'system' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS j FROM kept)"""
REFUSES = "(" + " OR ".join(f"contains(lower(text), {quoted(p)})" for p in REFUSALS) + ")"
FIRST_USER = rf"arg_min(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), turn)"
QUIZ = f"""word AS (SELECT doc_id AS q, string_split({norm("text")}, ' ')[40] AS word, text AS answer, lang AS prop FROM documents),
quiz AS (SELECT a.q, CASE a.q % 3 WHEN 0 THEN 'attr' WHEN 1 THEN 'def' ELSE 'nq' END AS kind, CASE WHEN {md5_mod("a.q", 4)} = 0 THEN coalesce(b.word, a.word) ELSE a.word END AS gold, a.answer, a.prop
  FROM word a LEFT JOIN word b ON b.q = a.q + 1),
graded AS (SELECT *, CASE WHEN length(trim(coalesce(gold, ''))) >= 2 AND contains(' ' || trim(regexp_replace(lower(answer), '[^a-z0-9]+', ' ', 'g')) || ' ', ' ' || gold || ' ') THEN 'right'
  WHEN regexp_matches(answer, {quoted(ABSTAIN)}) THEN 'abstain' ELSE 'wrong' END AS grade FROM quiz)"""
JUDGED = f"""judged AS (SELECT conv_id AS id, (turn + 1)::INT AS n, {md5_mod("(conv_id || '-' || turn)", 5)} != 0 AS ok,
  CASE turn % 3 WHEN 0 THEN 'Ignores the question' WHEN 1 THEN 'Wrong fact' ELSE 'Repeats itself' END AS problem FROM conversations WHERE role = 'assistant')"""
MESSAGES = "msgs AS (SELECT conv_id AS id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, role, text FROM conversations)"
HEAD = "'<|start_header_id|>' || role || '<|end_header_id|>' || chr(10) || chr(10)"
PAIRS = f"""{JUDGED}, {MESSAGES},
bad AS (SELECT id, n, 'A better reply.' AS better FROM judged WHERE NOT ok AND n % 2 = 0),
hist AS (SELECT b.id, b.n, string_agg({HEAD} || {strip("text")} || '<|eot_id|>', '' ORDER BY i) AS h, bool_or(contains(text, '<|')) AS marks
  FROM bad b JOIN msgs m ON m.id = b.id AND m.i <= 2 * (b.n - 1) + 1 GROUP BY 1, 2),
made AS (SELECT b.id, b.n, b.better, h.h, m.role, {strip("m.text")} AS wrong,
  coalesce(m.role = 'assistant', false) AND NOT coalesce(h.marks OR contains({strip("m.text")}, '<|'), false) AND coalesce({strip("m.text")} NOT IN ('', b.better), false) AS fine
  FROM bad b LEFT JOIN hist h USING (id, n) LEFT JOIN msgs m ON m.id = b.id AND m.i = 2 * (b.n - 1) + 2),
pairs AS (SELECT 'fixture:' || id || ':' || n AS source, id, CASE WHEN fine THEN '<|begin_of_text|>' || h || '<|start_header_id|>assistant<|end_header_id|>' || chr(10) || chr(10) END AS prompt,
  CASE WHEN fine THEN better || '<|eot_id|>' END AS chosen, CASE WHEN fine THEN wrong || '<|eot_id|>' END AS rejected, NOT fine AS skipped FROM made)"""
LOGS = "logs AS (SELECT lang, source, quality, toxic FROM documents JOIN labels USING (doc_id))"
SENTENCES = r"""s AS (SELECT doc_id, text, string_split(regexp_replace(text, '([.!?])[ \t\n\r\f\v]+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS s FROM documents),
p AS (SELECT doc_id, text, unnest(range(1, len(s))) AS i, s FROM s)"""

DENY = r"(?i)^\W*(no\b|nope\b|i can't|i can’t|i cannot|i'm not\b|i’m not\b|i am not\b|i don't have|sorry\b|i'm sorry)|^[^.\n]{0,80}, but i can't|\bI(?:'|’)m not (a|an|your) \w+"
TOKEN = r"[\p{L}\p{N}_'/.@#-]+|[^\p{L}\p{N}_'/.@#-]+"
PLAIN = r"^[a-z]{3,}(#.*)?$"
ELIGIBLE = f"""(length(text) BETWEEN 6 AND 160 AND NOT regexp_matches(text, {quoted(chr(91) + "`" + chr(34) + "“”<>{}" + chr(92) * 2 + "=" + chr(92) + "n" + chr(93))}) AND NOT regexp_matches(text, {quoted(EXACT)})
AND len(list_filter(regexp_extract_all(text, {quoted(TOKEN)}), lambda x: regexp_matches(x, {quoted(PLAIN)}))) > 0)"""
# Neighbouring keys.
NEAR = {"a": "sq", "s": "ad", "d": "sf", "e": "wr", "r": "et", "t": "ry", "i": "uo", "o": "ip", "n": "bm", "m": "n", "l": "k", "c": "xv", "u": "yi", "h": "gj", "g": "fh"}


def slips(seed: str) -> str:
    """CTEs from m(key, text, go, ...) to slipped(..., new, noised)."""
    u = lambda name: uniform("key", f"{seed}-{name}")
    words, kinds, made = [], [], []
    for k in (1, 2):
        words.append(f"regexp_extract(t[p{k}], '^[a-z]+') AS w{k}, coalesce(t[p{k} + 1] = ' ' AND regexp_matches(t[p{k} + 2], '^\\p{{Ll}}') AND NOT contains(t[p{k}], '#'), false) AS f{k}")
        x = f"floor({u(f'kind{k}')} * CASE WHEN f{k} THEN 12 ELSE 10 END)"
        kinds.append(f"CASE WHEN {x} < 3 THEN 'swap' WHEN {x} < 6 THEN 'drop' WHEN {x} < 7 THEN 'double' WHEN {x} < 9 THEN 'split' WHEN {x} < 10 THEN 'near' ELSE 'shift' END AS k{k}, floor({u(f'place{k}')} * (length(w{k}) - 1))::INT + 1 AS a{k}, substr(t[p{k}], length(w{k}) + 1) AS r{k}")
        w, a = f"w{k}", f"a{k}"
        near = f"CASE substr({w}, {a} + 1, 1) " + " ".join(f"WHEN '{x}' THEN '{y}'" for x, y in NEAR.items()) + " END"
        made.append(f"""CASE k{k} WHEN 'swap' THEN substr({w}, 1, {a} - 1) || substr({w}, {a} + 1, 1) || substr({w}, {a}, 1) || substr({w}, {a} + 2) WHEN 'double' THEN substr({w}, 1, {a}) || substr({w}, {a}) WHEN 'split' THEN substr({w}, 1, {a}) || ' ' || substr({w}, {a} + 1)
 WHEN 'near' THEN substr({w}, 1, {a}) || coalesce(substr({near}, floor({u(f'near{k}')} * length({near}))::INT + 1, 1), '') || substr({w}, {a} + 2) WHEN 'shift' THEN substr({w}, 1, length({w}) - 1) || ' ' || right({w}, 1) ELSE substr({w}, 1, {a}) || substr({w}, {a} + 2) END || r{k} AS s{k}""")
    return f"""c1 AS (SELECT *, CASE WHEN go THEN regexp_extract_all(text, {quoted(TOKEN)}) END AS t FROM m),
c2 AS (SELECT *, list_filter(range(1, len(t) + 1), lambda j: regexp_matches(t[j], {quoted(PLAIN)})) AS w FROM c1),
c3 AS (SELECT *, floor({u("first")} * len(w))::INT AS i1, floor({u("second")} * (len(w) - 1))::INT AS i2, {u("two")} >= 0.7 AND len(w) > 1 AS two FROM c2),
c4 AS (SELECT *, w[i1 + 1] AS p1, CASE WHEN two THEN w[i2 + CASE WHEN i2 >= i1 THEN 1 ELSE 0 END + 1] END AS p2 FROM c3),
c5 AS (SELECT *, {", ".join(words)} FROM c4), c6 AS (SELECT *, {", ".join(kinds)} FROM c5), c7 AS (SELECT *, {", ".join(made)} FROM c6),
c8 AS (SELECT *, array_to_string(list_transform(range(1, len(t) + 1), lambda j: CASE WHEN j = p1 THEN s1 WHEN j = p2 THEN s2 WHEN (k1 = 'shift' AND j = p1 + 1) OR (k2 = 'shift' AND j = p2 + 1) THEN '' ELSE t[j] END), '') AS new FROM c7),
slipped AS (SELECT *, coalesce(go AND new != text, false) AS noised FROM c8)"""


DROPS = f"""{CHAT},
early AS (SELECT conv_id, arg_min(r, turn) AS r FROM (SELECT conv_id, turn, CASE WHEN role NOT IN ('system', 'user', 'assistant') THEN 'drop_role' WHEN text IS NULL OR (c = '' AND role != 'system') THEN 'drop_empty' END AS r FROM clean) WHERE r IS NOT NULL GROUP BY 1),
shape AS (SELECT conv_id, count(*) FILTER (WHERE j > 0) AS n, bool_or(j > 0 AND role != CASE WHEN j % 2 = 1 THEN 'user' ELSE 'assistant' END) AS bad, bool_or(regexp_matches(c, '<think>|<tool_call>|<tools>')) AS tools FROM lead GROUP BY 1),
late AS (SELECT conv_id, arg_min(r, i) AS r FROM (SELECT conv_id, i, CASE WHEN role = 'assistant' AND {REFUSES} THEN 'drop_refusal' WHEN role IN ('assistant', 'system') AND regexp_matches(c, {quoted(FOREIGN)}) THEN 'drop_foreign_identity' END AS r FROM lead) WHERE r IS NOT NULL GROUP BY 1),
reasons AS (SELECT conv_id, coalesce(early.r, CASE WHEN coalesce(n, 0) < 2 OR n % 2 = 1 OR bad THEN 'drop_structure' WHEN tools THEN 'drop_tools_think' END, late.r) AS reason FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN early USING (conv_id) LEFT JOIN shape USING (conv_id) LEFT JOIN late USING (conv_id))"""
COUNTERS = f"""{DROPS}, r AS (SELECT 'part' || (conv_id % 3) AS source, reason, conv_id FROM reasons),
counters AS (SELECT source, 'seen' AS counter FROM r UNION ALL SELECT source, coalesce(reason, 'passed_filters') FROM r UNION ALL SELECT source, 'kept' FROM r WHERE reason IS NULL AND conv_id % 4 != 0)"""

ORACLES = {
    "norm_documents": f"SELECT doc_id, {norm('text')} AS norm FROM documents",
    "probe_build": f"WITH {PROBES} SELECT id AS item_id, k, pat FROM probes",
    "contam_hits": HIT_ROWS,
    "contam_hits_automaton": HIT_ROWS,
    "contam_summary": f"""WITH {PROBES}, per AS (SELECT bench, id, count(*) AS n FROM probes GROUP BY 1, 2),
seen AS (SELECT bench, id, count(DISTINCT k) AS m FROM hits GROUP BY 1, 2),
p AS (SELECT bench, count(*) AS probed, count(m) AS any_hit, count(CASE WHEN m = n THEN 1 END) AS all_hit FROM per LEFT JOIN seen USING (bench, id) GROUP BY 1)
SELECT i.bench, i.items, probed, any_hit, all_hit, round(100.0 * any_hit / greatest(1, probed), 2) AS pct_any, round(100.0 * all_hit / greatest(1, probed), 2) AS pct_all
FROM (SELECT bench, count(*) AS items FROM items GROUP BY 1) i JOIN p USING (bench)""",
    "contam_by_source": f"WITH {PROBES} SELECT source, count(DISTINCT id) AS items_hit, count(*) AS hits FROM hits GROUP BY 1",
    "corpus_stats": "SELECT source, count(*) AS records, sum(strlen(text))::BIGINT AS text_bytes, count(DISTINCT lang) AS shards FROM documents GROUP BY 1",
    "contam_context": f"""WITH {PROBES}, f AS (SELECT DISTINCT doc_id, pat, n, strpos(n, pat) + length(pat) - 2 AS e FROM hits)
SELECT doc_id, pat, substr(n, greatest(0, e - 200) + 1, e + 120 - greatest(0, e - 200)) AS ctx FROM f""",
    "decontaminate_docs": f"WITH {PROBES} SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM hits)",
    "accuracy_split": f"""WITH {PROBES}, logs AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'x' ELSE 'y' END AS bench, 'm' || (doc_id % 3) AS model, doc_id, quality, doc_id IN (SELECT doc_id FROM hits) AS hit FROM labels),
kept AS (SELECT * FROM logs WHERE bench = 'x' OR doc_id IN (SELECT doc_id FROM documents WHERE n_chars >= 1500)),
s AS (SELECT bench, model, count(*) FILTER (hit) AS n_hit, 100.0 * coalesce(sum(quality) FILTER (hit), 0) / greatest(1, count(*) FILTER (hit)) AS acc_hit, count(*) FILTER (NOT hit) AS n_clean,
  100.0 * coalesce(sum(quality) FILTER (NOT hit), 0) / greatest(1, count(*) FILTER (NOT hit)) AS acc_clean FROM kept GROUP BY 1, 2) SELECT *, acc_hit - acc_clean AS gap FROM s""",
    "chat_assemble": "SELECT conv_id, count(*) AS n_turns, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS transcript FROM conversations GROUP BY 1",
    "chat_drop_reasons": f"WITH {DROPS} SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM reasons GROUP BY 1",
    "chat_refusal_flags": f"SELECT conv_id, turn, {REFUSES} AS refusal FROM conversations WHERE role = 'assistant'",
    "chat_identity_flags": f"SELECT conv_id, turn, regexp_matches(text, {quoted(FOREIGN)}) AS foreign FROM conversations WHERE role IN ('assistant', 'system')",
    "same_prompt_antijoin": f"""WITH p AS (SELECT conv_id, {FIRST_USER} AS prompt FROM conversations WHERE role = 'user' GROUP BY 1),
q AS (SELECT c.conv_id, prompt, {md5_mod("c.conv_id", 4)} = 0 AS made FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN p USING (conv_id))
SELECT conv_id FROM q WHERE NOT made AND NOT EXISTS (SELECT 1 FROM q o WHERE o.made AND o.prompt = q.prompt)""",
    "first_user_freq": f"SELECT prompt, count(*) AS n FROM (SELECT c.conv_id, prompt FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN (SELECT conv_id, {FIRST_USER} AS prompt FROM conversations WHERE role = 'user' GROUP BY 1) USING (conv_id)) GROUP BY 1",
    "render_template": f"SELECT conv_id, '<|begin_of_text|>' || string_agg({HEAD} || trim(text) || '<|eot_id|>', '' ORDER BY turn) AS rendered FROM conversations GROUP BY 1",
    "pack_history": f"SELECT conv_id, string_agg(CASE WHEN i = 1 THEN '' ELSE '<|eot_id|>' || {HEAD} END || text, '' ORDER BY i) AS packed FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations) GROUP BY 1",
    "system_prompt_insert": f"""WITH c AS (SELECT conv_id, count(*) AS n, arg_min(role, turn) AS f FROM conversations GROUP BY 1),
a AS (SELECT *, f != 'system' AND {uniform("conv_id", "system")} < 0.25 AS added FROM c)
SELECT conv_id, added, n + added::INT AS n_messages, CASE WHEN added THEN 'system' ELSE f END AS first_role FROM a""",
    "holdout_mod50": f"SELECT doc_id, {md5_mod('doc_id', 50)} = 0 AS held FROM documents",
    "holdout_mod8": f"SELECT doc_id, {md5_mod('doc_id', 8)} = 0 AS held FROM documents",
    "reservoir_cap": """WITH a AS (SELECT doc_id, source, n_chars, row_number() OVER (PARTITION BY source ORDER BY md5('reservoir:' || doc_id)) AS r FROM documents),
b AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5('reservoir:' || doc_id)) AS r2 FROM a WHERE r <= 23 AND n_chars <= 8000)
SELECT doc_id, source, n_chars FROM b WHERE r2 <= 20""",
    "merge_caps": """SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('caps:' || doc_id)) AS r FROM documents)
WHERE r <= CASE lang WHEN 'en' THEN 100 WHEN 'fr' THEN 40 WHEN 'de' THEN 30 ELSE 1073741824 END""",
    "train_eval_split": "SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5('split:' || doc_id)) <= 200 THEN 'eval' ELSE 'train' END AS split FROM documents",
    "two_pass_shards": "SELECT doc_id, p::INT AS pass, ((row_number() OVER (PARTITION BY p ORDER BY md5('order:' || p || ':' || doc_id)) - 1) % 8)::INT AS shard FROM documents, range(2) t(p)",
    "oversample_self": "SELECT source, sum(CASE WHEN source = 'src0' THEN 2 ELSE 1 END)::BIGINT AS n FROM documents GROUP BY 1",
    "mix_summary": f"SELECT coalesce(source, '_all') AS source, count(*) AS examples, sum(t)::BIGINT AS tokens, sum(t) / count(*) AS mean_tokens FROM (SELECT source, {TOKENS} AS t FROM documents) GROUP BY ROLLUP (source)",
    "mixture_weights": """WITH m AS (SELECT lang, CASE lang WHEN 'en' THEN 0.55::DOUBLE WHEN 'fr' THEN 0.2::DOUBLE WHEN 'de' THEN 0.15::DOUBLE ELSE 0.1::DOUBLE END AS share, avg(n_chars) AS avg_tokens FROM documents GROUP BY 1)
SELECT lang, share, avg_tokens, round(share / avg_tokens / sum(share / avg_tokens) OVER (), 9) AS doc_weight, round(share * avg_tokens / sum(share * avg_tokens) OVER (), 9) AS token_share FROM m""",
    "token_count": f"SELECT doc_id, {TOKENS} AS n_tokens FROM documents",
    "length_filter": f"SELECT doc_id, n AS n_tokens, n <= 4096 AS fits_first, n + CASE WHEN {uniform('doc_id', 'system')} < 0.25 THEN 20 ELSE 0 END <= 1024 AS fits_second FROM (SELECT doc_id, {TOKENS} AS n FROM documents)",
    "length_hist": """SELECT CASE WHEN n_chars < 1000 THEN '0-1000' WHEN n_chars < 4000 THEN '1000-4000' WHEN n_chars < 8000 THEN '4000-8000' WHEN n_chars < 16000 THEN '8000-16000' WHEN n_chars < 32000 THEN '16000-32000' ELSE '32000-1000000000' END AS bin,
count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1""",
    "word_topk": f"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z]{{4,}}')) AS word FROM documents),
c AS (SELECT doc_id, word, count(*) AS n FROM w WHERE word NOT IN ({", ".join(map(quoted, STOP))}) GROUP BY 1, 2 HAVING count(*) BETWEEN 3 AND 60)
SELECT * FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, word) AS rank, word, n FROM c) WHERE rank <= 6""",
    "next_sentence": f"""WITH {SENTENCES} SELECT doc_id, (i - 1)::INT AS pos, s[i] AS sentence, s[i + 1] AS following FROM p
WHERE length(s[i]) BETWEEN 60 AND 200 AND length(s[i + 1]) BETWEEN 40 AND 250 AND (length(text) - length(replace(text, s[i], ''))) / length(s[i]) = 1""",
    "grade_quiz": f"WITH {QUIZ} SELECT q, gold, grade FROM graded",
    "cap_fallthrough": f"""WITH {QUIZ}, a AS (SELECT *, row_number() OVER (PARTITION BY kind, grade = 'wrong' ORDER BY md5('additions:' || q)) AS r FROM graded),
b AS (SELECT *, grade = 'wrong' AND r <= CASE kind WHEN 'def' THEN 60 WHEN 'attr' THEN 50 ELSE 40 END AS idk FROM a),
c AS (SELECT *, grade = 'wrong' AND NOT idk AND kind != 'def' AND gold IS NOT NULL AS spare FROM b),
e AS (SELECT *, row_number() OVER (PARTITION BY spare ORDER BY md5('additions:' || q)) AS r2 FROM c)
SELECT kind, grade, CASE WHEN idk THEN 'abstain' WHEN spare AND r2 <= 45 THEN 'correct' WHEN grade = 'right' AND kind != 'def' AND gold IS NOT NULL THEN 'known' ELSE 'none' END AS chosen, count(*) AS n, sum(q)::BIGINT AS q_sum FROM e GROUP BY 1, 2, 3""",
    "wrong_alternatives": f"""WITH {QUIZ}, r AS (SELECT * FROM graded WHERE kind = 'attr' AND gold IS NOT NULL AND grade = 'right'), pool AS (SELECT DISTINCT prop, gold AS alt FROM r)
SELECT q, any_value(r.gold) AS gold, arg_min(alt, md5(alt)) FILTER (WHERE lower(alt) != lower(r.gold) AND NOT contains(lower(answer), lower(alt))) AS alt FROM r JOIN pool USING (prop) GROUP BY q""",
    "transition_matrix": f"""WITH {QUIZ}, t AS (SELECT grade AS before, CASE WHEN {md5_mod("q", 3)} = 0 THEN 'abstain' ELSE grade END AS after FROM graded), c AS (SELECT before, after, count(*) AS n FROM t GROUP BY 1, 2)
SELECT before, after, n, 100.0 * n / sum(n) OVER (PARTITION BY before) AS row_pct, 100.0 * n / sum(n) OVER () AS pct FROM c""",
    "stress_report": f"""WITH {JUDGED}
SELECT 'turns_ok' AS metric, '' AS key, 100.0 * avg(ok::INT) AS value FROM judged
UNION ALL SELECT 'clean_conversations', '', 100.0 * avg(o::INT) FROM (SELECT id, bool_and(ok) AS o FROM judged GROUP BY 1)
UNION ALL SELECT 'bad_by_turn', least(n, 9)::VARCHAR, 100.0 * avg((NOT ok)::INT) FROM judged GROUP BY 2
UNION ALL SELECT * FROM (SELECT 'problem', lower(substr(problem, 1, 40)) AS key, count(*)::DOUBLE AS value FROM judged WHERE NOT ok GROUP BY 2 ORDER BY value DESC, key LIMIT 8)""",
    "dpo_pairs": f"WITH {PAIRS} SELECT source, id, prompt, chosen, rejected, skipped FROM pairs",
    "dpo_split": f"""WITH {PAIRS}, m AS (SELECT source, id FROM pairs WHERE NOT skipped), g AS (SELECT id, row_number() OVER (ORDER BY md5('eval:' || id)) AS r FROM (SELECT DISTINCT id FROM m))
SELECT m.id, source, CASE WHEN r <= greatest(1, (SELECT count(*) // 4 FROM g)) THEN 'eval' ELSE 'train' END AS split FROM m JOIN g USING (id)""",
    "dpo_summary": f"WITH {PAIRS} SELECT count(*) FILTER (WHERE NOT skipped) AS pairs, count(*) FILTER (WHERE skipped) AS skipped, round(avg(length(prompt)), 6) AS mean_prompt, round(avg(length(rejected)), 6) AS mean_rejected FROM pairs",
    "newest_per_task": "SELECT source AS task, lpad(max(doc_id)::VARCHAR, 12, '0') AS path, arg_max(n_chars, doc_id) AS value FROM documents GROUP BY 1",
    "score_pivot": f"WITH {LOGS} SELECT source, " + ", ".join(f"avg(coalesce(quality, toxic)::DOUBLE) FILTER (WHERE lang = '{x}') AS {x}" for x in ("de", "en", "es", "fr")) + " FROM logs GROUP BY 1",
    "subtask_mean": f"WITH {LOGS}, v AS (SELECT lang, source, avg(quality) AS v FROM logs GROUP BY 1, 2) SELECT lang, avg(v) AS score, count(v) = 20 AS complete FROM v GROUP BY 1",
    "weighted_group_score": f"WITH {LOGS} SELECT lang, sum(v * n) / sum(n) AS score FROM (SELECT lang, source, avg(quality) AS v, count(*) AS n FROM logs GROUP BY 1, 2) GROUP BY 1",
    "score_interval": f"WITH {LOGS} SELECT lang, round(avg(quality), 9) AS mean, round(1.96 * stddev_samp(quality) / sqrt(count(quality)), 9) AS half_width FROM logs GROUP BY 1",
    "api_spend": "SELECT round((sum(CASE WHEN role = 'assistant' THEN 0 ELSE length(text) END) * 0.25::DOUBLE + sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)) / 1e6, 9) AS usd FROM conversations",
    "stall_detector": """WITH a AS (SELECT event_id, user_id, event_type, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
b AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM a),
e AS (SELECT event_id, (row_number() OVER (PARTITION BY user_id, run ORDER BY event_id))::INT AS in_a_row FROM b) SELECT * FROM e WHERE in_a_row >= 3""",
    "loss_spikes": """WITH a AS (SELECT event_id, value, avg(value) OVER w AS m, stddev_samp(value) OVER w AS s FROM events WHERE value IS NOT NULL WINDOW w AS (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 128 PRECEDING AND 1 PRECEDING))
SELECT event_id FROM a WHERE value > m + 2.5 * s""",
    "chunk_sequences": f"""WITH t AS (SELECT doc_id, {TOKENS} AS n FROM documents)
SELECT doc_id, chunk, least(1024, n - chunk * 1024) AS length FROM (SELECT doc_id, n, unnest(range(greatest(n - 1, 0) // 1024 + 1)) AS chunk FROM t)""",
    "length_buckets": f"SELECT CASE WHEN u <= 0.15 THEN '8k' WHEN u <= 0.35 THEN '16k' WHEN u <= 0.65 THEN '32k' ELSE '48k' END AS bucket, count(*) AS n FROM (SELECT {uniform('doc_id', 'length')} AS u FROM documents) GROUP BY 1",
    "accept_share": f"SELECT doc_id FROM documents WHERE {uniform('doc_id', 'accept')} < 0.35",
    "boxed_answer": r"SELECT doc_id, '\frac{' || doc_id || '}{2}' AS answer FROM documents",
    "resume_antijoin": "SELECT doc_id, source FROM documents WHERE doc_id % 3 != 0",
    "pushback_rates": f"SELECT 100.0 * avg(CASE WHEN conv_id % 2 = 0 THEN a::INT END) AS accept_pct, 100.0 * avg(CASE WHEN conv_id % 2 = 1 THEN a::INT END) AS cave_pct FROM (SELECT conv_id, regexp_matches(text, {quoted(ACCEPT)}) AS a FROM conversations WHERE role = 'assistant')",
    "probe_tallies": f"""WITH {JUDGED} SELECT 'probe' AS level, problem AS name, count(*) FILTER (NOT ok) AS bad, count(*) AS n FROM judged GROUP BY 2
UNION ALL SELECT 'group', CASE WHEN id % 2 = 0 THEN 'clean' ELSE 'typo' END, count(*) FILTER (NOT ok), count(*) FROM judged GROUP BY 2""",
    "prompt_windows": """SELECT concat_ws(' ', CASE WHEN length(text) > 30 AND length(text) < 1500 THEN 'math' END, CASE WHEN length(text) > 50 AND length(text) < 2500 THEN 'code' END, CASE WHEN length(text) > 20 AND length(text) < 3000 THEN 'general' END) AS fits, count(*) AS n FROM conversations WHERE role = 'user' GROUP BY 1""",
    "source_renames": "SELECT source, count(*) AS n FROM (SELECT replace(source, 'src', 'verified_') AS source FROM documents UNION ALL SELECT 'chat' FROM conversations) GROUP BY 1",
    "first_hit_bench": f"WITH {PROBES} SELECT doc_id, arg_min(pat, (strpos(n, pat) + length(pat)) * 1000 + 0) AS pat FROM (SELECT DISTINCT doc_id, pat, n FROM hits) GROUP BY 1",
    "planted_notes": f"""WITH p AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {strip("x")}), lambda x: x != '') AS p FROM documents),
q AS (SELECT doc_id, p, [{", ".join(map(quoted, TOPICS))}][floor({uniform("doc_id", "note-topic")} * {len(TOPICS)})::INT + 1] AS topic, lpad(floor({uniform("doc_id", "note-code")} * 1000000)::INT::VARCHAR, 6, '0') AS code, floor({uniform("doc_id", "note-place")} * (len(p) + 1))::INT AS place FROM p WHERE len(p) >= 12)
SELECT doc_id, array_to_string(p[:place] || ['Note: the access code of the ' || topic || ' is ' || code || '.'] || p[place + 1:], chr(10) || chr(10)) AS text, 'What is the access code of the ' || topic || '?' AS question, code AS answer, place FROM q""",
    "budget_prefix": f"""WITH p AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {strip("x")}), lambda x: x != '' AND length(x) <= 3000) AS p FROM documents),
u AS (SELECT doc_id, unnest(range(1, len(p) + 1)) AS i, p FROM p), c AS (SELECT doc_id, i, length(p[i]) + 2 AS n FROM u),
r AS (SELECT doc_id, i, n, sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS cum FROM c),
k AS (SELECT doc_id, count(*) AS n_kept, sum(n)::BIGINT AS chars FROM r WHERE cum <= 4200 GROUP BY 1)
SELECT doc_id, coalesce(n_kept, 0) AS n_kept, coalesce(chars, 0) AS chars FROM documents LEFT JOIN k USING (doc_id)""",
    "typo_eligible": f"SELECT conv_id, turn, {ELIGIBLE} AS fit FROM conversations WHERE role = 'user'",
    "weighted_interleave": "SELECT doc_id, lang, (row_number() OVER (PARTITION BY lang ORDER BY md5('interleave:' || doc_id)) - 0.5::DOUBLE) / CASE lang WHEN 'en' THEN 4.0::DOUBLE WHEN 'fr' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS position FROM documents",
    "quick_build": "SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('quick:' || doc_id)) AS r FROM documents) WHERE r <= 50",
    "pool_pairing": f"""WITH pool AS (SELECT item_id, row_number() OVER (ORDER BY md5('pool:' || item_id)) AS place FROM benchmark)
SELECT conv_id, item_id FROM (SELECT DISTINCT conv_id FROM conversations) c JOIN pool ON place = floor({uniform("conv_id", "pool")} * (SELECT count(*) FROM pool))::BIGINT + 1""",
    "short_answer_rows": f"""WITH t AS (SELECT conv_id, turn, role, lag(role) OVER w AS before, lag(text) OVER w AS q FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
p AS (SELECT conv_id, q, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS part, count(*) OVER (PARTITION BY conv_id) AS n FROM t WHERE role = 'assistant' AND before = 'user'),
k AS (SELECT *, {uniform("conv_id", "short")} AS k, floor({uniform("conv_id", "short-n")} * 3)::INT + 3 AS more FROM p)
SELECT conv_id, part::INT AS part, CASE WHEN k < 0.25 AND n >= 3 THEN 'chat' WHEN k >= 0.55 THEN 'tools' ELSE 'single' END AS kind,
CASE WHEN k < 0.25 AND n >= 3 THEN 2 * least(n, more) ELSE 2 END AS n_messages, q AS opening FROM k WHERE NOT (k < 0.25 AND n >= 3) OR part = 0""",
    "invented_terms": f"""SELECT DISTINCT replace({drawn(("What is {t}?", "Tell me about {t}.", "How does {t} work?"), "doc_id", "terms-q")}, '{{t}}', term) AS question, term
FROM (SELECT doc_id, {drawn(HEADS, "doc_id", "terms-h")} || {drawn(MIDS, "doc_id", "terms-m")} || {drawn(TAILS, "doc_id", "terms-t")} AS term FROM documents)""",
    "denial_openers": f"SELECT conv_id, turn, regexp_matches(text, {quoted(DENIAL)}) AS denies, regexp_matches(text, {quoted(CLAIM)}) AS claims FROM conversations WHERE role = 'assistant'",
    "typo_noise": f"""WITH m AS (SELECT key, text, {ELIGIBLE} AND {uniform("key", "typos")} < 0.25 AS go FROM (SELECT conv_id || '-' || turn AS key, text FROM conversations WHERE role = 'user')), {slips("typos")}
SELECT key, CASE WHEN noised THEN new ELSE text END AS text, noised FROM slipped""",
    "typo_conversations": f"""WITH r AS (SELECT *, conv_id || '-' || turn AS key, md5('slips-order:' || conv_id || '-' || turn) AS d FROM conversations),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role = 'user' ORDER BY d) AS o FROM r),
m AS (SELECT *, role = 'user' AND o <= 3 AND {uniform("conv_id", "slips-share")} < 0.5 AND conv_id % 5 != 0 AND {ELIGIBLE} AS go FROM o), {slips("slips")},
b AS (SELECT *, noised AND d = min(CASE WHEN noised THEN d END) OVER (PARTITION BY conv_id) AS best FROM slipped)
SELECT conv_id, turn, CASE WHEN best THEN new ELSE text END AS text, coalesce(best, false) AS noised FROM b""",
    "contam_by_bench": f"WITH {BENCHES} SELECT bench, source AS ds, count(DISTINCT id) AS items_hit, count(*) AS hits FROM hits GROUP BY 1, 2",
    "contam_examples": f"""WITH {PLACES}, r AS (SELECT *, row_number() OVER (PARTITION BY bench ORDER BY doc_id, e, id, k) AS rank FROM occ)
SELECT bench, rank, id AS item_id, doc_id, substr(n, greatest(0, e - 200) + 1, e + 120 - greatest(0, e - 200)) AS ctx FROM r WHERE rank <= 8""",
    "contam_hit_ids": f"WITH {BENCHES} SELECT bench, string_agg(id::VARCHAR, ' ' ORDER BY id) AS ids FROM (SELECT DISTINCT bench, id FROM hits) GROUP BY 1",
    "contam_occurrences": f"""WITH {PLACES} SELECT bench, coalesce(source, '_all') AS source, count(DISTINCT id) AS items, count(*) AS occurrences FROM occ WHERE bench != 'humaneval_solution' GROUP BY GROUPING SETS ((bench, source), (bench))""",
    "overlap_counters": f"""WITH {PLACES}, f AS (SELECT doc_id, source, bench FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY e, length(pat) DESC, bench DESC, pat DESC) AS r FROM occ WHERE bench != 'humaneval_solution') WHERE r = 1)
SELECT 'source' AS "by", source AS name, count(*) AS n FROM f GROUP BY 2 UNION ALL SELECT 'bench', bench, count(*) FROM f GROUP BY 2""",
    "chat_overlap_lines": "SELECT source, count(*) FILTER (doc_id % 7 != 0) AS examples, count(*) FILTER (doc_id % 7 = 0) AS bad_lines FROM documents GROUP BY 1",
    "opening_turns": "SELECT conv_id, string_agg(text, chr(10) || '--' || chr(10) ORDER BY turn) AS asked FROM (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations WHERE role = 'user' WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE i <= 4 AND n >= 2 GROUP BY 1",
    "role_names": "SELECT conv_id, turn, role FROM conversations",
    "cleaned_turns": f"SELECT conv_id, turn, {strip('text')} AS text FROM conversations",
    "thinking_rows": f"""WITH m AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations WHERE role != 'system'),
c AS (SELECT conv_id, count(*) AS n, bool_and(role = CASE WHEN i % 2 = 1 THEN 'user' ELSE 'assistant' END AND (role = 'user' OR ({strip("text")} != '' AND NOT {REFUSES} AND NOT regexp_matches(text, {quoted(FOREIGN)}) AND NOT regexp_matches(text, '[\\x{{1F000}}-\\x{{1FAFF}}\\x{{2600}}-\\x{{27BF}}]')))) AS ok,
  string_agg(CASE WHEN role = 'assistant' THEN '<think>so</think> ' || regexp_replace(text, '\\s+$', '') WHEN {strip("text")} = '' THEN '/think' ELSE {strip("text")} END, chr(10) ORDER BY i) AS body FROM m GROUP BY 1)
SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN 'Be brief. /think' ELSE ['/think', 'You are a helpful assistant. Answer directly and helpfully. /think', 'Think step by step before answering. /think'][floor({uniform("conv_id", "think")} * 3)::INT + 1] END AS system, body FROM c WHERE ok AND n >= 2 AND n % 2 = 0""",
    "tool_conversations": r"""SELECT id, reason, CASE WHEN kept IS NOT NULL THEN 'system:TOOLS|user:q|' || replace(kept, '~', chr(10)) END AS kept, direct FROM (VALUES
(1, NULL, 'assistant:<tool_call>~{"name": "f", "arguments": {"zeta": 1, "alpha": 2}}~</tool_call>|user!:1|assistant:done', false),
(2, NULL, 'assistant:I look. <tool_call>~{"name": "f", "arguments": {"all": true, "q": "it''s", "n": null}}~</tool_call>', false),
(3, 'drop_no_tools', NULL, NULL), (4, 'drop_bad_tools_json', NULL, NULL), (5, 'drop_bad_tools_json', NULL, NULL), (6, 'drop_bad_call_json', NULL, NULL), (7, 'drop_structure', NULL, NULL),
(8, 'drop_refusal', NULL, NULL), (9, 'drop_foreign_identity', NULL, NULL), (10, 'drop_structure', NULL, NULL), (11, NULL, 'assistant:plain answer', true), (12, 'drop_bad_call_json', NULL, NULL),
(13, 'drop_structure', NULL, NULL), (14, NULL, 'assistant:<tool_call>~{"name": "", "arguments": "none"}~</tool_call>', false)) t(id, reason, kept, direct)""",
    "generated_conversations": """SELECT id, kept FROM (VALUES (1, 'user:q|assistant:<tool_call>{"name": "f", "arguments": {"a": 1}}</tool_call>|tool:<tool_response>1 — 2</tool_response>|assistant:one, two'), (2, 'user:q, r|assistant:I''m not ChatGPT.'),
(3, NULL), (4, NULL), (5, NULL), (6, NULL), (7, NULL), (8, NULL), (9, NULL), (10, NULL), (11, NULL), (12, 'user:q|assistant:a|user:r|assistant:b')) t(id, kept)""",
    "flagged_template": f"""SELECT conv_id, '<|begin_of_text|>' || string_agg(CASE WHEN i % 3 = 0 THEN {HEAD.replace("role", "'tool'")} ELSE {HEAD} END || trim(text) || '<|eot_id|>', '' ORDER BY i) || CASE WHEN conv_id % 2 = 1 THEN {HEAD.replace("role", "'assistant'")} ELSE '' END AS rendered
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations) GROUP BY conv_id""",
    "line_exclusion": "SELECT doc_id FROM documents WHERE NOT ((source = 'src1' AND doc_id % 50 IN (3, 7)) OR (source = 'src2' AND doc_id % 50 = 11))",
    "self_denials": f"""WITH t AS (SELECT conv_id, turn, ['Nope, ', 'I am a large language model and ', 'Well, but i can''t ', 'I''m not a person: ', ''][conv_id % 5 + 1] || text AS t FROM conversations)
SELECT conv_id, turn, regexp_matches(t, {quoted(DENY)}) AS denies, regexp_matches(t, '(?i)language model|1\\.6 billion') AS recites FROM t""",
    "split_keys": f"SELECT item_id, CASE WHEN length(n) < 160 THEN n ELSE trim(substr(n, 1, 80)) END AS key FROM (SELECT item_id, {norm('text')} AS n FROM benchmark)",
    "answer_forms": r"""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN doc_id::VARCHAR WHEN 1 THEN doc_id || '.5' WHEN 2 THEN '\frac' || doc_id || '7' ELSE 'x' || doc_id END AS norm, doc_id::VARCHAR AS line,
CASE doc_id % 4 WHEN 0 THEN CASE WHEN doc_id >= 10 THEN doc_id::VARCHAR END WHEN 1 THEN 'a ' || doc_id END AS gold FROM documents""",
    "sentence_forms": rf"""SELECT doc_id, trim(CASE WHEN c = '' THEN l ELSE c END) AS first, lang || ', ' || source || ', x,' AS dashes, 'We add ' || doc_id || '. So it is done. End' AS traced, '{{"a": {{"b": ' || doc_id || '}}}}' AS object
FROM (SELECT *, regexp_extract(l, '^(.*?[.!?])\s', 1) AS c FROM (SELECT *, string_split({strip("text")}, chr(10))[1] AS l FROM documents))""",
    "template_check": "SELECT DISTINCT 'Sorry, no {s} in ' || source AS template FROM documents WHERE doc_id % 5 = 0",
    "most_frequent_word": f"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z]{{4,}}')) AS word FROM documents),
c AS (SELECT doc_id, word, count(*) AS n FROM w WHERE word NOT IN ({", ".join(map(quoted, STOP))}) GROUP BY 1, 2 HAVING count(*) BETWEEN 3 AND 60),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, word) AS r FROM c)
SELECT doc_id, CASE WHEN max(n) - max(n) FILTER (r = 2) >= 2 THEN max(word) FILTER (r = 1) END AS word FROM r WHERE r <= 4 GROUP BY 1 HAVING count(*) = 4""",
    "filter_counters": f"WITH {COUNTERS} SELECT source, counter, count(*) AS n FROM counters GROUP BY 1, 2",
    "merged_counters": f"""WITH {COUNTERS}, every AS (SELECT source, counter, count(*) AS n FROM counters GROUP BY 1, 2 UNION ALL VALUES ('part0', 'drop_eval_overlap', 2), ('part0', 'seen', 5), ('part9', 'seen', 1))
SELECT source, counter, sum(n)::BIGINT AS n FROM every GROUP BY 1, 2""",
    "api_budget": """WITH u AS (SELECT conv_id * 1000 + turn AS call, (CASE WHEN role = 'assistant' THEN length(text)::DOUBLE ELSE length(text) * 0.25::DOUBLE END) / 1e6 AS cost FROM conversations),
s AS (SELECT call, cost, sum(cost) OVER (ORDER BY call) AS usd FROM u) SELECT call, round(usd, 9) AS usd FROM s WHERE usd - cost < 0.001""",
    "source_quotas": "SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('quota:' || doc_id)) AS r FROM documents) WHERE r <= CASE source WHEN 'src0' THEN 5 WHEN 'src1' THEN 9 WHEN 'src2' THEN 2 ELSE 0 END",
    "first_accepted": f"SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents WHERE {uniform('doc_id', 'accept')} <= 0.35) WHERE r <= 4",
    "stage_mixes": """WITH m AS (SELECT * FROM (VALUES ('1', 'nemotron-cc', 0.35::DOUBLE), ('1', 'ultra-fineweb', 0.35), ('1', 'starcoder', 0.16), ('1', 'finemath', 0.06), ('1', 'open-web-math', 0.04), ('1', 'megamath', 0.04),
('2', 'nemotron-cc', 0.30), ('2', 'ultra-fineweb', 0.30), ('2', 'starcoder', 0.22), ('2', 'finemath', 0.07), ('2', 'open-web-math', 0.05), ('2', 'megamath', 0.06), ('3', 'nemotron-cc', 0.27), ('3', 'ultra-fineweb', 0.28),
('3', 'starcoder', 0.22), ('3', 'finemath', 0.05), ('3', 'open-web-math', 0.03), ('3', 'megamath', 0.05), ('3', 'openthoughts', 0.012), ('3', 'nemotron-math', 0.14)) t(stage, source, weight))
SELECT stage, source, weight, round(weight / sum(weight) OVER (PARTITION BY stage), 9) AS share, round(weight * 1000)::BIGINT * 2097152 AS tokens FROM m""",
    "cut_sequences": f"SELECT doc_id, least(1024, n) AS kept, greatest(0, n - 1024) AS lost FROM (SELECT doc_id, {TOKENS} AS n FROM documents)",
    "planted_chains": f"""WITH a AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {strip("x")}), lambda x: x != '') AS p FROM documents),
b AS (SELECT * FROM a WHERE len(p) >= 10 AND list_sum(list_transform(p, lambda x: {TOKENS.replace("text", "x")} + 2)) >= 200),
c AS (SELECT *, lpad(floor({uniform("doc_id", "chain-value")} * 90000)::INT::VARCHAR, 5, '1') AS v, {", ".join(f"{drawn(TOPICS, 'doc_id', f'chain-name{j}')} || '-{j}-' || floor({uniform('doc_id', f'chain-mark{j}')} * 90)::INT AS n{j}, lpad(floor({uniform('doc_id', f'chain-code{j}')} * 1000000)::INT::VARCHAR, 6, '0') AS c{j}, floor(({j} + {uniform('doc_id', f'chain-place{j}')}) * len(p) / 3)::INT AS p{j}" for j in range(3))}, floor({uniform("doc_id", "chain-style")} * 3)::INT AS style FROM b),
d AS (SELECT *, [{{'at': p0, 'a': 'Let ' || n0 || ' be ' || v || '.', 'b': 'For the record, the code of ' || n0 || ' is ' || c0 || '.'}}, {{'at': p1, 'a': 'Let ' || n1 || ' be equal to ' || n0 || '.', 'b': 'For the record, the code of ' || n1 || ' is ' || c1 || '.'}}, {{'at': p2, 'a': 'Let ' || n2 || ' be equal to ' || n1 || '.', 'b': 'For the record, the code of ' || n2 || ' is ' || c2 || '.'}}] AS h FROM c),
e AS (SELECT *, array_to_string(flatten(list_transform(range(0, len(p)), lambda i: flatten(list_transform(list_filter(h, lambda y: y['at'] = i), lambda z: [z['a'], z['b']])) || [p[i + 1]])), chr(10) || chr(10)) AS doc FROM d),
f AS (SELECT doc_id, doc || {" || ".join(f"chr(10) || chr(10) || CASE style WHEN 0 THEN 'Question: What is the {what} of ' || n{j} || '?' || chr(10) || 'Answer: ' || {x} WHEN 1 THEN 'Q: What is the {what} of ' || n{j} || '?' || chr(10) || 'A: ' || {x} ELSE 'The {what} of ' || n{j} || ' is: ' || {x} END" for what, xs in (("value", ("v", "v", "v")), ("code", ("c0", "c1", "c2"))) for j, x in enumerate(xs))} AS text FROM e)
SELECT doc_id, text, {TOKENS} AS tokens, 6 AS n_questions FROM f WHERE {TOKENS} <= 4000""",
    "synthetic_manifest": """WITH s AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'science' ELSE 'books' END AS kind, n_chars AS t, 1 + (doc_id % 3 = 0)::INT + (doc_id % 5 = 0)::INT AS q, doc_id, doc_id % 11 = 0 AS bad FROM documents), g AS (SELECT * FROM s WHERE NOT bad)
SELECT 'records' AS metric, '' AS key, count(*)::DOUBLE AS value FROM g UNION ALL SELECT 'total_tokens', '', sum(t)::DOUBLE FROM g UNION ALL SELECT 'avg_tokens', '', avg(t) FROM g UNION ALL SELECT 'max_tokens', '', max(t)::DOUBLE FROM g
UNION ALL SELECT 'avg_questions', '', avg(q) FROM g UNION ALL SELECT 'errors', '', count(*)::DOUBLE FROM s WHERE bad UNION ALL SELECT 'by_kind', kind, count(*)::DOUBLE FROM g GROUP BY 2
UNION ALL SELECT 'length', CASE WHEN t < 8000 THEN '0-8000' WHEN t < 16000 THEN '8000-16000' WHEN t < 32000 THEN '16000-32000' WHEN t < 48000 THEN '32000-48000' ELSE '48000-1000000000' END, count(*)::DOUBLE FROM g GROUP BY 2
UNION ALL SELECT 'tasks', k, count(*)::DOUBLE FROM (SELECT unnest(list_filter(['count', CASE WHEN doc_id % 3 = 0 THEN 'chain' END, CASE WHEN doc_id % 5 = 0 THEN 'first' END], lambda x: x IS NOT NULL)) AS k FROM g) GROUP BY 2""",
    "last_judgments": f"""WITH {JUDGED}, l AS (SELECT id, max(n) AS n, arg_max(ok, n) AS ok FROM judged GROUP BY 1) SELECT id, c.n_messages, l.n, ok FROM l JOIN (SELECT conv_id AS id, count(*) AS n_messages FROM conversations GROUP BY 1) c USING (id)""",
    "shard_files": """WITH a AS (SELECT doc_id, p::INT AS pass, ((row_number() OVER (PARTITION BY p ORDER BY md5('files:' || p || ':' || doc_id)) - 1) % 4)::INT AS shard FROM documents, range(2) t(p))
SELECT pass, shard, count(*) AS n, sum(doc_id)::BIGINT AS id_sum FROM a WHERE doc_id NOT IN (SELECT doc_id FROM a WHERE pass = 1 AND shard = 3) GROUP BY 1, 2""",
    "benchmark_items": """SELECT 'gsm8k' AS bench, item_id::VARCHAR AS id, text FROM benchmark UNION ALL SELECT 'arc_easy', 'q' || item_id, text FROM benchmark UNION ALL SELECT 'winogrande', item_id::VARCHAR, text FROM benchmark
UNION ALL SELECT 'humaneval_prompt', 't' || item_id, text FROM benchmark UNION ALL SELECT 'triviaqa', 'v' || item_id, text FROM benchmark
UNION ALL SELECT 'hellaswag', item_id::VARCHAR, substr(text, 1, 30) || ' ' || substr(text, 31 + 10 * (item_id % 4), 10) FROM benchmark UNION ALL SELECT 'piqa', item_id::VARCHAR, substr(text, 1, 30) || ' ' || substr(text, 31 + 10 * (item_id % 2), 10) FROM benchmark""",
}
