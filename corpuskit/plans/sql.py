"""The SQL each core query is checked against, written for its meaning, not from its plan."""

from __future__ import annotations

from corpuskit.functions.labels import CATEGORIES, SENTIMENTS

_WS = r"[\t-\r\x1c- \x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_PLAT = "lower(trim(platform))"


def _toks(c: str) -> str:
    return f"list_filter(regexp_split_to_array({c}, '{_WS}+'), lambda t: t <> '')"


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^{_WS}+|{_WS}+$', '', 'g')"


def _in(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


_NFC = "nfc_normalize"
#: A text's lines with single spaces, blank lines left out.
_TIDY = rf"regexp_replace(regexp_replace({_strip('text')}, '{_WS[:-1].replace(chr(92) + 't-', chr(92) + 't' + chr(92) + 'x0b-')}]+', ' ', 'g'), ' ?(' || chr(10) || ' ?)+', chr(10), 'g')"
#: Annotated sentences, each once.
_A = "a AS (SELECT DISTINCT ON (sentence_id) * FROM annotated_sentences ORDER BY sentence_id)"
#: Raw records, the first of each sentence by seq.
_R = "r AS (SELECT DISTINCT ON (sentence_id) * FROM raw_sentences WHERE sentence_id IS NOT NULL ORDER BY sentence_id, seq)"
_FIRST = f"f AS (SELECT arg_min(seq, seq) AS seq, arg_min(sentence_id, seq) AS sentence_id, arg_min(text, seq) AS text FROM raw_sentences WHERE text IS NOT NULL GROUP BY {_NFC}(text))"
_POOL = f"p AS (SELECT sentence_id, coalesce({_PLAT}, 'none') AS platform, md5('42|' || sentence_id) AS h FROM r)"


def _script(c: str) -> str:
    dev, lat = f"len(regexp_extract_all({c}, '[ऀ-ॿ]'))", f"len(regexp_extract_all({c}, '[A-Za-z]'))"
    return f"CASE WHEN {dev} = 0 AND {lat} = 0 THEN 'other' WHEN {dev} >= {lat} THEN 'devanagari' ELSE 'latin' END"


def _language(c: str, raj, eng) -> str:
    s = _script(c)
    return f"CASE {s} WHEN 'devanagari' THEN CASE WHEN {c} IN ({_in(raj)}) THEN 'RAJ' ELSE 'HIN' END WHEN 'latin' THEN CASE WHEN lower({c}) IN ({_in(eng)}) THEN 'ENG' ELSE 'TRL' END ELSE 'HIN' END"


def _sure(c: str, raj, eng) -> str:
    return f"CASE WHEN {_script(c)} = 'other' THEN 0.60 ELSE CASE {_language(c, raj, eng)} WHEN 'RAJ' THEN 0.90 WHEN 'HIN' THEN 0.80 WHEN 'ENG' THEN 0.95 ELSE 0.75 END END::DOUBLE"


def _hits(text: str, words) -> str:
    return f"coalesce(len(list_filter(list_distinct(list_concat({_toks(text)}, {_toks(f'lower({text})')})), lambda t: t IN ({_in(sorted(set(words)))}))), 0)"


def _prf(by: str = "") -> str:
    k = f"{by}, " if by else ""
    return f"{k}label, tp, fp, fn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6)::DOUBLE AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6)::DOUBLE AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6)::DOUBLE AS f1"


def _kappa_tail(by: str, equal: str) -> str:
    """From c (by, a, b, units, same, products)."""
    k = "(same / units - products / (units::DOUBLE * units)) / nullif(1 - products / (units::DOUBLE * units), 0)"
    return f"SELECT {by}, a, b, units, same, round({equal.format(k=k)}, 6)::DOUBLE AS kappa FROM c"


_SV = f"v AS (SELECT DISTINCT batch_id, item_id, annotator, lower(trim(label)) AS x FROM sentiment_votes WHERE lower(trim(label)) IN ({_in(SENTIMENTS)}))"
_SK = f"""WITH {_SV}, q AS (SELECT u.batch_id, u.annotator AS a, w.annotator AS b, u.x AS xa, w.x AS xb FROM v u JOIN v w ON u.batch_id = w.batch_id AND u.item_id = w.item_id AND u.annotator < w.annotator),
c AS (SELECT batch_id, a, b, count(*) AS units, count(*) FILTER (xa = xb) AS same, {' + '.join(f"count(*) FILTER (xa = '{s}')::DOUBLE * count(*) FILTER (xb = '{s}')" for s in SENTIMENTS)} AS products FROM q GROUP BY ALL) """
_TV = f"v AS (SELECT batch_id, item_id, annotator, c.category, bool_or(list_contains(labels, c.category)) AS x FROM tox_votes, (SELECT unnest([{_in(CATEGORIES)}]) AS category) c WHERE labels IS NOT NULL GROUP BY 1, 2, 3, 4)"
_TK = f"""WITH {_TV}, q AS (SELECT u.batch_id, u.category, u.annotator AS a, w.annotator AS b, u.x AS xa, w.x AS xb FROM v u JOIN v w ON u.batch_id = w.batch_id AND u.item_id = w.item_id AND u.category = w.category AND u.annotator < w.annotator),
c AS (SELECT batch_id, category, a, b, count(*) AS units, count(*) FILTER (xa = xb) AS same, count(*) FILTER (xa)::DOUBLE * count(*) FILTER (xb) + count(*) FILTER (NOT xa)::DOUBLE * count(*) FILTER (NOT xb) AS products FROM q GROUP BY ALL) """
_NK = """WITH s AS (SELECT DISTINCT batch_id, annotator, start, "end", entity_type FROM span_votes), u AS (SELECT DISTINCT batch_id, start, "end", entity_type FROM s), j AS (SELECT DISTINCT batch_id, annotator FROM sentiment_votes),
m AS (SELECT j.batch_id, j.annotator, u.start, u."end", u.entity_type, s.annotator IS NOT NULL AS x FROM j LEFT JOIN u ON j.batch_id = u.batch_id LEFT JOIN s ON s.batch_id = j.batch_id AND s.annotator = j.annotator AND s.start = u.start AND s."end" = u."end" AND s.entity_type = u.entity_type),
q AS (SELECT m.batch_id, m.annotator AS a, n.annotator AS b, m.x AS xa, n.x AS xb, m.start FROM m JOIN m n ON m.batch_id = n.batch_id AND m.start IS NOT DISTINCT FROM n.start AND m."end" IS NOT DISTINCT FROM n."end" AND m.entity_type IS NOT DISTINCT FROM n.entity_type AND m.annotator < n.annotator),
c AS (SELECT batch_id, a, b, count(start) AS units, count(start) FILTER (xa = xb) AS same, count(start) FILTER (xa)::DOUBLE * count(start) FILTER (xb) + count(start) FILTER (NOT xa)::DOUBLE * count(start) FILTER (NOT xb) AS products FROM q GROUP BY ALL) """
_NP = """WITH s AS (SELECT DISTINCT batch_id, item_id, annotator, start, "end", entity_type FROM span_votes), j AS (SELECT DISTINCT batch_id, item_id, annotator FROM sentiment_votes), u AS (SELECT DISTINCT batch_id, item_id, start, "end", entity_type FROM s),
m AS (SELECT u.*, j.annotator, s.annotator IS NOT NULL AS x FROM u JOIN j USING (batch_id, item_id) LEFT JOIN s ON s.batch_id = u.batch_id AND s.item_id = u.item_id AND s.annotator = j.annotator AND s.start = u.start AND s."end" = u."end" AND s.entity_type = u.entity_type),
q AS (SELECT m.batch_id, m.annotator AS a, n.annotator AS b, m.x AS xa, n.x AS xb FROM m JOIN m n ON m.batch_id = n.batch_id AND m.item_id = n.item_id AND m.start = n.start AND m."end" = n."end" AND m.entity_type = n.entity_type AND m.annotator < n.annotator),
c AS (SELECT batch_id, a, b, count(*) AS units, count(*) FILTER (xa = xb) AS same, count(*) FILTER (xa)::DOUBLE * count(*) FILTER (xb) + count(*) FILTER (NOT xa)::DOUBLE * count(*) FILTER (NOT xb) AS products FROM q GROUP BY ALL) """
_EQ1 = "CASE WHEN same = units THEN 1.0 ELSE {k} END"
_MAJ = "(SELECT max(struct_pack(n := n, l := l)).l FROM (SELECT l, count(*) AS n FROM (SELECT unnest(sentiment_annotator_labels) AS l) WHERE l IS NOT NULL GROUP BY l HAVING count(*) >= 2))"
_SPANS = 'w AS (SELECT sentence_id, text, unnest(list_transform(range(1, len(ner_annotator_spans) + 1), lambda i: struct_pack(k := i, s := ner_annotator_spans[i]))) AS m FROM a), y AS (SELECT DISTINCT sentence_id, text, k, p.start AS start, p."end" AS "end", p.entity_type AS entity_type FROM (SELECT sentence_id, text, m.k AS k, unnest(m.s) AS p FROM w)), g AS (SELECT sentence_id, text, start, "end", entity_type FROM y GROUP BY ALL HAVING count(*) >= 2)'
_CATS = f"x AS (SELECT sentence_id, c.category, len(list_filter(toxicity_annotator_labels, lambda z: list_contains(z, c.category))) AS n FROM a, (SELECT unnest([{_in(CATEGORIES)}]) AS category) c), k AS (SELECT sentence_id, coalesce(string_agg(category, ',' ORDER BY category) FILTER (n >= 2), '') AS labels FROM x GROUP BY 1)"


def sql(lexicon, english, positive, negative, keywords, entities) -> dict[str, str]:
    sent = f"h AS (SELECT *, {_hits('text', positive)} AS p, {_hits('text', negative)} AS n FROM a), z AS (SELECT *, CASE WHEN p > n THEN 'positive' WHEN n > p THEN 'negative' ELSE 'neutral' END AS l, CASE WHEN p + n = 0 THEN 0.6 WHEN p = n THEN 0.5 ELSE 0.5 + 0.4::DOUBLE * (greatest(p, n) / (p + n + 1)) END::DOUBLE AS conf FROM h)"
    sent_prf = "m AS (SELECT s.label, count(*) FILTER (sentiment = s.label AND l = s.label) AS tp, count(*) FILTER (sentiment <> s.label AND l = s.label) AS fp, count(*) FILTER (sentiment = s.label AND l <> s.label) AS fn{by} FROM z, (SELECT unnest([" + _in(SENTIMENTS) + "]) AS label) s WHERE sentiment IS NOT NULL GROUP BY ALL)"
    scores = ", ".join(f"least(1.0, {_hits('text', w)} / {max(1.0, len(set(w)) * 0.2)}::DOUBLE)::DOUBLE AS {c}" for c, w in keywords.items())
    tox = f"z AS (SELECT *, {scores} FROM a), t AS (SELECT *, list_filter([{', '.join(f'CASE WHEN {c} >= 0.5 THEN {chr(39)}{c}{chr(39)} END' for c in keywords)}], lambda x: x IS NOT NULL) AS l FROM z)"
    tox_prf = "m AS (SELECT s.label, count(*) FILTER (g AND q) AS tp, count(*) FILTER (NOT g AND q) AS fp, count(*) FILTER (g AND NOT q) AS fn{by} FROM (SELECT s.label, t.platform AS platform0, coalesce(list_contains(toxicity_labels, s.label), false) AS g, list_contains(l, s.label) AS q FROM t, (SELECT unnest([" + _in(CATEGORIES) + "]) AS label) s) s GROUP BY ALL)"
    lang = _language("t", lexicon, english)
    cube = "SELECT coalesce(s, 'all') AS split, coalesce(p, 'all') AS platform, count(*) AS records, sum(t)::BIGINT AS tokens, count(*) FILTER (e) AS with_entity, count(*) FILTER (x) AS toxic" + "".join(f", count(*) FILTER (sentiment = '{s}') AS {s}" for s in ("positive", "neutral", "negative"))
    events = "l AS (SELECT event_id, ts, user_id::VARCHAR AS annotator_id, CASE WHEN event_type = 'signup' THEN 'assign' WHEN event_type = 'error' AND event_id % 5 = 0 THEN 'opt_out' WHEN event_type = 'purchase' THEN 'reassign' WHEN event_type = 'click' THEN 'expose' END AS kind, 's' || (event_id % 97) AS sentence_id, floor(value)::INT AS n FROM events)"
    got = "g AS (SELECT * FROM l WHERE kind IN ('assign', 'reassign')), o AS (SELECT * FROM l WHERE kind = 'opt_out')"
    released = "rel AS (SELECT DISTINCT g.annotator_id, g.sentence_id, (SELECT min((o.ts, o.event_id)) FROM o WHERE o.annotator_id = g.annotator_id AND (o.ts, o.event_id) > (g.ts, g.event_id)) AS due FROM g)"
    tokens = f"k AS (SELECT sentence_id, text, generate_subscripts({_toks('text')}, 1) - 1 AS i, unnest({_toks('text')}) AS t FROM a)"
    longest = " ".join(f"WHEN {' AND '.join(f't{j} = ' + _in([w]) for j, w in enumerate(p))} THEN struct_pack(n := {len(p)}, e := '{e}')" for p, e in sorted(entities, key=lambda x: -len(x[0])))
    most = max(len(p) for p, _ in entities)
    ner = f"""{tokens}, b AS (SELECT *, {', '.join(f'lead(t, {j}) OVER w AS t{j}' if j else 't AS t0' for j in range(most))} FROM k WINDOW w AS (PARTITION BY sentence_id ORDER BY i)),
hit AS (SELECT sentence_id, text, i, CASE {longest} END AS hit FROM b), o AS (SELECT *, row_number() OVER (PARTITION BY sentence_id ORDER BY i) AS r FROM hit WHERE hit IS NOT NULL),
walk AS (SELECT sentence_id, text, i, hit, r, i + hit.n AS free, true AS took FROM o WHERE r = 1 UNION ALL SELECT o.sentence_id, o.text, o.i, o.hit, o.r, CASE WHEN o.i >= walk.free THEN o.i + o.hit.n ELSE walk.free END, o.i >= walk.free FROM walk JOIN o ON o.sentence_id = walk.sentence_id AND o.r = walk.r + 1),
pos AS (SELECT sentence_id, i, t, length(list_aggregate(list_slice(regexp_split_to_array(text, '[^' || '{_WS[1:-1]}' || ']+'), 1, i + 1), 'string_agg', '')) + sum(length(t)) OVER (PARTITION BY sentence_id ORDER BY i) - length(t) AS s FROM k),
sp AS (SELECT DISTINCT x.sentence_id, x.text, x.hit.e AS entity_type, a0.s::INT AS start, (a1.s + length(a1.t))::INT AS "end" FROM walk x JOIN pos a0 ON a0.sentence_id = x.sentence_id AND a0.i = x.i JOIN pos a1 ON a1.sentence_id = x.sentence_id AND a1.i = x.i + x.hit.n - 1 WHERE took)"""
    gold = 'gold AS (SELECT DISTINCT sentence_id, p.start AS start, p."end" AS "end", p.entity_type AS entity_type FROM (SELECT sentence_id, unnest(ner_spans) AS p FROM a))'
    ner_prf = 'm AS (SELECT coalesce(gold.entity_type, sp.entity_type) AS label, count(*) FILTER (gold.start IS NOT NULL AND sp.start IS NOT NULL) AS tp, count(*) FILTER (gold.start IS NULL) AS fp, count(*) FILTER (sp.start IS NULL) AS fn FROM gold FULL JOIN sp ON gold.sentence_id = sp.sentence_id AND gold.start = sp.start AND gold."end" = sp."end" AND gold.entity_type = sp.entity_type GROUP BY 1)'
    plat = "CASE WHEN lower(trim({c})) IN ('twitter', 'sharechat') THEN lower(trim({c})) ELSE 'twitter' END AS plat"
    f1 = "avg(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0))"
    ner_by = ner_prf.replace(" GROUP BY 1)", " JOIN a ON a.sentence_id = coalesce(gold.sentence_id, sp.sentence_id) GROUP BY ALL)").replace(" AS label,", f" AS label, {plat.format(c='a.platform')},")
    macros = f"""mac AS (SELECT 'sentiment' AS task, plat AS platform, macro_f1 FROM (WITH {_A}, {sent}, {sent_prf.format(by=', ' + plat.format(c='platform'))} SELECT plat, {f1} AS macro_f1 FROM m GROUP BY 1)
UNION ALL SELECT 'toxicity', plat, macro_f1 FROM (WITH {_A}, {tox}, {tox_prf.format(by=', ' + plat.format(c='platform0'))} SELECT plat, {f1} AS macro_f1 FROM m GROUP BY 1)
UNION ALL SELECT 'ner', plat, macro_f1 FROM (WITH RECURSIVE {_A}, {ner}, {gold}, {ner_by} SELECT plat, {f1} AS macro_f1 FROM m GROUP BY 1))"""
    heads = {
        "sentiment": ("Classify the sentiment of the following Rajasthani-Hindi sentence.|Labels: positive, neutral, negative.||", "Sentiment", "sentiment"),
        "ner": ("Identify named entities (PER, LOC, ORG) in the following Rajasthani-Hindi sentence.||", "Entities", "coalesce(nullif(array_to_string(list_transform(ner_spans, lambda p: p.text || ' (' || p.entity_type || ')'), ', '), ''), 'none')"),
        "toxicity": ("Classify the toxicity of the following Rajasthani-Hindi sentence.|Categories (select all that apply): caste_slur, religious, gender, general.|If none apply, output: none.||", "Toxicity", "coalesce(nullif(array_to_string(toxicity_labels, ', '), ''), 'none')"),
    }
    line = "chr(10)"
    prompts = " UNION ALL ".join(
        f"SELECT sentence_id, '{t}' AS task, md5(replace('{h}', '|', {line}) || coalesce((SELECT string_agg('Example ' || r || ':' || {line} || '  Sentence: ' || text || {line} || '  {n}: ' || {v} || {line}, {line} ORDER BY r) || {line} FROM shots), '') || 'Sentence: ' || text || {line} || '{n}:') AS digest FROM a WHERE split = 'test' AND text IS NOT NULL"
        for t, (h, n, v) in heads.items()
    )
    near = f"""WITH {_FIRST}, g AS (SELECT seq, list_distinct(list_transform(range(1, greatest(length({_NFC}(text)) - 1, 1)), lambda i: substring({_NFC}(text), i, 3))) AS s FROM f), u AS (SELECT seq, len(s) AS n, unnest(s) AS x FROM g),
df AS (SELECT x, count(*) AS c FROM u GROUP BY 1), rk AS (SELECT u.*, row_number() OVER (PARTITION BY seq ORDER BY c, u.x) AS r FROM u JOIN df USING (x)), pre AS (SELECT seq, x, n FROM rk WHERE r <= n - ceil(0.85 * n) + 1),
cand AS (SELECT DISTINCT a.seq AS a, b.seq AS b FROM pre a JOIN pre b ON a.x = b.x AND a.seq < b.seq), sz AS (SELECT cand.a, cand.b, len(list_intersect(p.s, q.s)) AS common, len(p.s) AS size_a, len(q.s) AS size_b FROM cand JOIN g p ON p.seq = cand.a JOIN g q ON q.seq = cand.b)"""
    bio = f"""pos AS (SELECT sentence_id, i, t, length(list_aggregate(list_slice(regexp_split_to_array(text, '[^{_WS[1:-1]}]+'), 1, i + 1), 'string_agg', '')) + sum(length(t)) OVER (PARTITION BY sentence_id ORDER BY i) - length(t) AS s FROM k),
g AS (SELECT sentence_id, generate_subscripts(ner_spans, 1) AS k, unnest(ner_spans) AS p FROM a), c AS (SELECT pos.sentence_id, i, arg_max(struct_pack(k := g.k, e := p.entity_type, s := p.start, n := p."end"), g.k) AS b FROM pos JOIN g ON g.sentence_id = pos.sentence_id AND pos.s >= p.start AND pos.s + length(t) <= p."end" GROUP BY ALL),
f AS (SELECT c.sentence_id, c.i, c.b, min(p2.i) AS first FROM c JOIN pos p2 ON p2.sentence_id = c.sentence_id AND p2.s >= c.b.s AND p2.s + length(p2.t) <= c.b.n GROUP BY ALL), tagged AS (SELECT pos.sentence_id, pos.i::INT AS token_no, pos.s, length(pos.t) AS n, CASE WHEN f.b IS NULL THEN 'O' WHEN f.first = pos.i THEN 'B-' || f.b.e ELSE 'I-' || f.b.e END AS tag FROM pos LEFT JOIN f ON f.sentence_id = pos.sentence_id AND f.i = pos.i)"""
    return {
        "near_dup_keep": f"""{near}, hit AS (SELECT a, b FROM sz WHERE 100 * common >= 85 * (size_a + size_b - common)),
gone AS (SELECT coalesce(list_reduce(list([a, b] ORDER BY b, a), lambda acc, x: CASE WHEN list_contains(acc, x[1]) THEN acc ELSE list_append(acc, x[2]) END, []::BIGINT[]), []::BIGINT[]) AS d FROM hit) SELECT seq, sentence_id FROM f WHERE NOT list_contains((SELECT d FROM gone), seq)""",
        "bio_round_trip": f"""WITH {_A}, {tokens}, {bio}, e AS (SELECT *, tag LIKE 'I-%' AND coalesce(substr(tag, 3) = substr(lag(tag) OVER (PARTITION BY sentence_id ORDER BY token_no), 3), false) AS goes_on FROM tagged),
u AS (SELECT *, sum(CASE WHEN goes_on THEN 0 ELSE 1 END) OVER (PARTITION BY sentence_id ORDER BY token_no) AS run, bool_and(tag NOT LIKE 'I-%' OR goes_on) OVER (PARTITION BY sentence_id) AS valid FROM e)
SELECT sentence_id, valid, min(s)::INT AS start, max(s + n)::INT AS "end", substr(arg_min(tag, token_no), 3) AS entity_type FROM u GROUP BY sentence_id, valid, run HAVING arg_min(tag, token_no) LIKE 'B-%'""",
        "platform_split_eval": f"WITH {macros}, d AS (SELECT * FROM (VALUES ('sentiment'), ('ner'), ('toxicity')) t(task), (VALUES ('twitter', 'sharechat'), ('sharechat', 'twitter')) p(train_platform, eval_platform)) SELECT d.task, train_platform, eval_platform, round(coalesce(macro_f1, 0), 6)::DOUBLE AS macro_f1 FROM d LEFT JOIN mac ON mac.task = d.task AND mac.platform = eval_platform",
        "release_gate": f"WITH {macros}, g AS (SELECT * FROM (VALUES ('sentiment', 0.3::DOUBLE), ('ner', 0.82), ('toxicity', 0.79)) t(task, target)) SELECT g.task, round(x, 6)::DOUBLE AS actual, target, coalesce(x >= target, false) AS passed FROM g LEFT JOIN (SELECT task, min(macro_f1) AS x FROM mac GROUP BY 1) w USING (task)",
        "training_log": f"WITH {macros} SELECT task || '/' || platform AS task, 1 AS best_epoch, round(macro_f1, 6)::DOUBLE AS best_f1, 4 AS epochs FROM mac",
        "comparison_pivot": f"WITH {_A}, own AS (SELECT printf('%.4f', x) AS s FROM (WITH {sent}, {sent_prf.format(by='')} SELECT {f1} AS x FROM m)), tox AS (SELECT printf('%.4f', x) AS s FROM (WITH {tox}, {tox_prf.format(by='')} SELECT {f1} AS x FROM m)) SELECT * FROM (VALUES (1, 'mBERT zero-shot', '0.4500', '0.3800', '0.3200'), (2, 'MuRIL zero-shot', '0.5200', '0.4400', '0.3800'), (3, 'GPT-4o 5-shot', '0.6200', '0.5800', '0.5100'), (4, 'lexicon', (SELECT s FROM own), 'N/A', (SELECT s FROM tox)), (5, 'lexicon + language tags', 'N/A', 'N/A', 'N/A'), (6, 'fine-tuned', 'N/A', 'N/A', 'N/A')) t(place, model_name, sentiment, ner, toxicity)",
        "few_shot_prompts": f"WITH {_A}, shots AS (SELECT *, row_number() OVER (ORDER BY sentence_id) AS r FROM a WHERE split = 'train' AND text IS NOT NULL AND sentiment IS NOT NULL AND toxicity_labels IS NOT NULL ORDER BY sentence_id LIMIT 5) {prompts}",
        "tokenize_counts": f"SELECT {_PLAT} AS platform, count(*) AS records, sum(coalesce(len({_toks('text')}), 0))::BIGINT AS tokens FROM raw_sentences GROUP BY 1",
        "nfc_changes": f"SELECT seq, {_NFC}(text) AS text FROM raw_sentences WHERE {_NFC}(text) <> text",
        "token_scripts": f"SELECT {_script('t')} AS script, count(*) AS n FROM (SELECT unnest({_toks('text')}) AS t FROM raw_sentences) GROUP BY 1",
        "token_offsets": f"""WITH k AS (SELECT seq, text, generate_subscripts({_toks('text')}, 1) - 1 AS i, unnest({_toks('text')}) AS t FROM raw_sentences), g AS (SELECT *, length(list_aggregate(list_slice(regexp_split_to_array(text, '[^{_WS[1:-1]}]+'), 1, i + 1), 'string_agg', '')) + sum(length(t)) OVER (PARTITION BY seq ORDER BY i) - length(t) AS s FROM k)
SELECT seq, i::INT AS token_no, t AS token, s::INT AS start, (s + length(t))::INT AS "end" FROM g""",
        "shingle_stats": f"SELECT {_PLAT} AS platform, sum(coalesce(len(list_distinct(list_transform(range(1, greatest(length(text) - 1, 1)), lambda i: substring(text, i, 3)))), 0))::BIGINT AS shingles FROM raw_sentences GROUP BY 1",
        "times_as_text": "SELECT seq, strftime(coalesce(collected_at, TIMESTAMP '1970-01-01'), '%Y-%m-%dT%H:%M:%SZ') AS collected_at FROM raw_sentences",
        "manual_import": f"WITH m AS (SELECT seq, {_NFC}({_strip('text')}) AS text, {_strip('source_url')} AS u, lower({_strip('platform')}) AS p FROM raw_sentences), n AS (SELECT *, CASE WHEN p IN ('twitter', 'facebook', 'whatsapp', 'sharechat', 'news', 'other') THEN p ELSE 'other' END AS q FROM m) SELECT seq, text, coalesce(nullif(u, ''), 'manual://' || q) AS source_url, CASE q WHEN 'sharechat' THEN 'sharechat' ELSE 'twitter' END AS platform FROM n WHERE length(text) >= 10",
        "min_length_filter": f"SELECT {_PLAT} AS platform, count(*) AS n FROM raw_sentences WHERE length({_NFC}({_strip('text')})) >= 10 GROUP BY 1",
        "lexicon_filter": f"SELECT seq, sentence_id FROM raw_sentences WHERE len(list_filter({_toks('lower(text)')}, lambda t: {_NFC}(t) IN ({_in(lexicon)}))) >= 2",
        "lexicon_filter_joined": f"SELECT seq, sentence_id FROM (SELECT seq, sentence_id, unnest({_toks('lower(text)')}) AS t FROM raw_sentences) WHERE {_NFC}(t) IN ({_in(lexicon)}) GROUP BY ALL HAVING count(*) >= 2",
        "lexicon_hits_by_platform": f"SELECT {_PLAT} AS platform, sum(coalesce(len(list_filter({_toks('lower(text)')}, lambda t: {_NFC}(t) IN ({_in(lexicon)}))), 0))::BIGINT AS hits FROM raw_sentences GROUP BY 1",
        "exact_dedup": f"WITH {_FIRST} SELECT seq, sentence_id FROM f",
        "dedup_split_counts": f"SELECT {_PLAT} AS platform, split, count(*) AS n FROM (SELECT platform, split FROM annotated_sentences WHERE text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {_NFC}(text) ORDER BY sentence_id, platform, split) = 1) GROUP BY 1, 2",
        "merge_first_by_id": "SELECT seq, sentence_id, text, source_url, platform FROM raw_sentences WHERE sentence_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY sentence_id ORDER BY CASE WHEN platform IN ('twitter', 'sharechat') THEN 0 ELSE 1 END, seq) = 1",
        "near_dup_pairs": f"""{near}
SELECT a, b, common::INT AS common, size_a::INT AS size_a, size_b::INT AS size_b FROM sz WHERE 100 * common >= 85 * (size_a + size_b - common)""",
        "stratified_sample": f"WITH {_R}, {_POOL}, c AS (SELECT platform, count(*) AS n FROM p GROUP BY 1), q AS (SELECT platform, n, 150 * n // (SELECT sum(n) FROM c) AS k FROM c), e AS (SELECT platform, k + CASE WHEN row_number() OVER (ORDER BY n DESC, platform) <= 150 - sum(k) OVER () THEN 1 ELSE 0 END AS k FROM q) SELECT sentence_id, platform FROM p JOIN e USING (platform) QUALIFY row_number() OVER (PARTITION BY platform ORDER BY h, sentence_id) <= k",
        "stratified_split": f"WITH {_R}, {_POOL}, n AS (SELECT *, row_number() OVER (PARTITION BY platform ORDER BY h, sentence_id) AS k, count(*) OVER (PARTITION BY platform) AS n FROM p) SELECT sentence_id, platform, CASE WHEN k <= n - 2 * (n // 10) THEN 'train' WHEN k <= n - n // 10 THEN 'validation' ELSE 'test' END AS split FROM n",
        "split_overlap": "SELECT sentence_id, count(DISTINCT split) AS splits FROM annotated_sentences GROUP BY 1 HAVING count(DISTINCT split) > 1",
        "holdout_counts": f"SELECT {_PLAT} AS platform, held_out, count(*) AS n FROM (SELECT platform, row_number() OVER (ORDER BY seq DESC) <= greatest(1, (SELECT count(*) FROM raw_sentences) // 10) AS held_out FROM raw_sentences) GROUP BY 1, 2",
        "oversampled": f"WITH {_A}, m AS (SELECT sentence_id, coalesce(len(toxicity_labels) > 0, false) AS tox, md5('42|' || sentence_id) AS h FROM a), t AS (SELECT count(*) FILTER (tox) AS k, count(*) FILTER (NOT tox) // 3 AS goal FROM m) SELECT sentence_id, CASE WHEN NOT tox OR goal <= k THEN 1 ELSE goal // k + CASE WHEN row_number() OVER (PARTITION BY tox ORDER BY h, sentence_id) <= goal % k THEN 1 ELSE 0 END END::BIGINT AS copies FROM m, t",
        "majority_sentiment": f"WITH {_A} SELECT sentence_id, {_MAJ} AS label FROM a",
        "majority_toxicity": f"WITH {_A}, {_CATS} SELECT sentence_id, labels FROM k",
        "majority_spans": f'WITH {_A}, {_SPANS} SELECT sentence_id, (row_number() OVER (PARTITION BY sentence_id ORDER BY start, "end", entity_type) - 1)::INT AS span_no, start, "end", entity_type, substring(text, start + 1, "end" - start) AS span_text FROM g',
        "toxicity_vote": f"SELECT item_id, l AS category FROM (SELECT DISTINCT item_id, annotator, l FROM (SELECT item_id, annotator, unnest(labels) AS l FROM tox_votes) WHERE l IN ({_in(CATEGORIES)})) GROUP BY ALL HAVING count(*) >= 2",
        "span_vote": 'SELECT item_id, start, "end", entity_type, count(*) AS n FROM (SELECT DISTINCT item_id, annotator, start, "end", entity_type FROM span_votes) GROUP BY ALL HAVING count(*) >= 2',
        "sentiment_export": f"WITH {_A} SELECT sentence_id, CASE WHEN platform IN ('twitter', 'sharechat') THEN platform ELSE 'twitter' END AS platform, coalesce({_MAJ}, 'neutral') AS sentiment, len(list_filter(sentiment_annotator_labels, lambda x: x IS NOT NULL))::INT AS annotators, strftime(coalesce(collected_at, TIMESTAMP '1970-01-01'), '%Y-%m-%dT%H:%M:%SZ') AS collected_at FROM a",
        "toxicity_export": f"WITH {_A}, {_CATS} SELECT sentence_id, labels, len(toxicity_annotator_labels)::INT AS annotators FROM k JOIN a USING (sentence_id)",
        "ner_export": f'WITH {_A}, {_SPANS} SELECT sentence_id, len(ner_annotator_spans)::INT AS annotators, g.start, g."end", g.entity_type FROM a LEFT JOIN g USING (sentence_id)',
        "adjudicated": f"WITH {_A}, e AS (SELECT DISTINCT ON (sentence_id) * FROM adjudicated_items ORDER BY sentence_id) SELECT sentence_id, coalesce(e.sentiment, a.sentiment) AS sentiment, array_to_string(coalesce(e.toxicity_labels, a.toxicity_labels), ',') AS labels, len(coalesce(e.ner_spans, a.ner_spans))::INT AS spans FROM a LEFT JOIN e USING (sentence_id)",
        "kappa_sentiment": _SK + _kappa_tail("batch_id", "{k}"),
        "kappa_toxicity": _TK + _kappa_tail("batch_id, category", _EQ1),
        "kappa_ner": _NK + _kappa_tail("batch_id", _EQ1),
        "kappa_ner_per_sentence": _NP + _kappa_tail("batch_id", _EQ1),
        "iaa_flags": f"WITH ks AS ({_SK + _kappa_tail('batch_id', '{k}').replace('round(', '(').replace(', 6)', ')')}), kt AS ({_TK + _kappa_tail('batch_id', _EQ1).replace('round(', '(').replace(', 6)', ')')}), kn AS ({_NK + _kappa_tail('batch_id', _EQ1).replace('round(', '(').replace(', 6)', ')')}), u AS (SELECT 'sentiment' AS task, 0.72 AS t, batch_id, kappa FROM ks UNION ALL SELECT 'toxicity', 0.65, batch_id, kappa FROM kt UNION ALL SELECT 'ner', 0.78, batch_id, kappa FROM kn), g AS (SELECT batch_id, task, t, avg(kappa) AS k, count(*) AS pairs, count(kappa) < count(*) AS degenerate FROM u GROUP BY ALL) SELECT batch_id, task, CASE WHEN NOT degenerate THEN round(k, 6) END::DOUBLE AS kappa, pairs, degenerate, coalesce(NOT degenerate AND k < t, false) AS flagged FROM g",
        "langid_tokens": f"WITH {_A}, {tokens} SELECT sentence_id, i::INT AS token_no, t AS token, {lang} AS label, {_sure('t', lexicon, english)} AS confidence FROM k",
        "langid_distribution": "SELECT t.label AS label, count(*) AS n FROM (SELECT unnest(token_language_labels) AS t FROM annotated_sentences) GROUP BY 1",
        "langid_metrics": f"WITH {_A}, {tokens}, j AS (SELECT token_language_labels[i + 1].label AS g, {lang} AS p FROM k JOIN a USING (sentence_id)), q AS (SELECT * FROM j WHERE g IS NOT NULL), m AS (SELECT s.label, count(*) FILTER (g = s.label AND p = s.label) AS tp, count(*) FILTER (g <> s.label AND p = s.label) AS fp, count(*) FILTER (g = s.label AND p <> s.label) AS fn FROM q, (SELECT unnest(['RAJ', 'HIN', 'ENG', 'TRL']) AS label) s GROUP BY ALL) SELECT label, tp, fp, fn, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6)::DOUBLE AS f1, (SELECT round(count(*) FILTER (g = p) / count(*), 6) FROM q)::DOUBLE AS accuracy FROM m",
        "langid_augmented": f"WITH {_A}, {tokens} SELECT a.sentence_id, coalesce(string_agg('[' || ({lang}) || '] ' || t, ' ' ORDER BY i), CASE WHEN any_value(a.text) IS NOT NULL THEN '' END) AS augmented FROM a LEFT JOIN k USING (sentence_id) GROUP BY 1",
        "sentiment_predict": f"WITH {_A}, {sent} SELECT sentence_id, l AS label, round(conf, 6) AS confidence FROM z",
        "sentiment_metrics": f"WITH {_A}, {sent}, {sent_prf.format(by='')} SELECT {_prf()} FROM m",
        "sentiment_ablation": f"WITH {_A}, {sent}, {sent_prf.format(by='')}, f AS (SELECT avg(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)) AS x FROM m) SELECT round(x, 6)::DOUBLE AS without_f1, round(x, 6)::DOUBLE AS with_f1, 0.0::DOUBLE AS improvement, false AS meets FROM f",
        "toxicity_predict": f"WITH {_A}, {tox} SELECT sentence_id, array_to_string(l, ',') AS labels, {', '.join(f'round({c}, 6) AS {c}' for c in CATEGORIES)} FROM t",
        "toxicity_metrics": f"WITH {_A}, {tox}, {tox_prf.format(by='')} SELECT {_prf()} FROM m",
        "should_oversample": f"WITH {_A}, {tox}, {tox_prf.format(by='')} SELECT bool_or(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) < 0.6) AS oversample FROM m",
        "class_weights": f"WITH {_A}, n AS (SELECT sentiment AS s, count(*) AS n FROM a WHERE sentiment IS NOT NULL GROUP BY 1) SELECT label, round(coalesce((SELECT sum(n) FROM n) / ((SELECT count(*) FROM n) * n), 1.0), 6)::DOUBLE AS weight FROM (SELECT unnest([{_in(SENTIMENTS)}]) AS label) LEFT JOIN n ON s = label",
        "toxicity_weights": f"WITH {_A} SELECT label, round(coalesce((SELECT count(*) FROM a) / nullif(2 * (SELECT count(*) FROM a WHERE list_contains(toxicity_labels, label)), 0), 1.0), 6)::DOUBLE AS weight FROM (SELECT unnest([{_in(CATEGORIES)}]) AS label)",
        "ner_tag": f'WITH RECURSIVE {_A}, {ner} SELECT sentence_id, start, "end", entity_type, substring(text, start + 1, "end" - start) AS span_text FROM sp',
        "ner_metrics": f"WITH RECURSIVE {_A}, {ner}, {gold}, {ner_prf} SELECT {_prf()} FROM m",
        "ner_bio": f"WITH {_A}, {tokens}, {bio} SELECT sentence_id, token_no, tag FROM tagged",
        "span_invariant_errors": f"""WITH {_A}, {_R}, q AS (SELECT a.sentence_id, r.text, 'ner_spans' AS span_set, generate_subscripts(ner_spans, 1) - 1 AS k, unnest(ner_spans) AS p FROM a JOIN r USING (sentence_id)), w AS (SELECT a.sentence_id, r.text, generate_subscripts(ner_annotator_spans, 1) - 1 AS g, unnest(ner_annotator_spans) AS s FROM a JOIN r USING (sentence_id)),
u AS (SELECT * FROM q UNION ALL SELECT sentence_id, text, 'ner_annotator_spans[' || g || ']', generate_subscripts(s, 1) - 1, unnest(s) FROM w) SELECT sentence_id, span_set, k::INT AS span_no, p.start AS start, p."end" AS "end", substring(text, p.start + 1, p."end" - p.start) AS text_there FROM u WHERE substring(text, p.start + 1, p."end" - p.start) IS DISTINCT FROM p.text""",
        "toxicity_label_errors": f"WITH v AS (SELECT DISTINCT item_id || '/' || annotator AS sentence_id, list_concat(labels, labels[1:1]) AS l FROM tox_votes), b AS (SELECT sentence_id, 'invalid' AS error, list_filter(l, lambda x: x NOT IN ({_in(CATEGORIES)})) AS labels FROM v UNION ALL SELECT sentence_id, 'duplicate', list_transform(list_filter(range(1, len(l) + 1), lambda i: list_contains(l[1:i - 1], l[i])), lambda i: l[i]) FROM v) SELECT sentence_id, error, array_to_string(labels, ',') AS labels FROM b WHERE len(labels) > 0",
        "schema_errors": f"WITH d AS (SELECT DISTINCT * FROM annotated_sentences) SELECT sentence_id, 'platform' AS field, platform AS value FROM d WHERE platform IS NULL OR platform NOT IN ('twitter', 'sharechat') UNION ALL SELECT sentence_id, 'split', split FROM d WHERE split IS NULL OR split NOT IN ('train', 'validation', 'test') UNION ALL SELECT sentence_id, 'sentiment', sentiment FROM d WHERE sentiment IS NULL OR sentiment NOT IN ({_in(SENTIMENTS)}) UNION ALL SELECT sentence_id, 'toxicity_labels', c FROM (SELECT sentence_id, unnest(toxicity_labels) AS c FROM d) WHERE c IS NULL OR c NOT IN ({_in(CATEGORIES)}) UNION ALL SELECT sentence_id, 'ner_spans', p.entity_type FROM (SELECT sentence_id, unnest(ner_spans) AS p FROM d) WHERE p.entity_type IS NULL OR p.entity_type NOT IN ('PER', 'LOC', 'ORG')" + "".join(f" UNION ALL SELECT sentence_id, '{c}', NULL FROM d WHERE {c} IS NULL" for c in ("sentence_id", "text", "sentiment_annotator_labels", "ner_spans", "ner_annotator_spans", "toxicity_labels", "toxicity_annotator_labels", "token_language_labels", "collected_at", "annotated_at")),
        "round_trip_failures": f"WITH {_A} SELECT sentence_id, 'text' AS fields FROM a WHERE {_NFC}(text) <> text",
        "round_trip_report": f"WITH {_A} SELECT count(*) AS records, count(*) - count(*) FILTER ({_NFC}(text) <> text) AS passed, count(*) FILTER ({_NFC}(text) <> text) AS failed FROM a",
        "csv_import": f"WITH m AS (SELECT {_NFC}({_strip('text')}) AS text, {_strip('source_url')} AS u, lower({_strip('platform')}) AS p FROM raw_sentences), n AS (SELECT *, CASE WHEN p IN ('twitter', 'facebook', 'whatsapp', 'sharechat', 'news', 'other') THEN p ELSE 'other' END AS q FROM m) SELECT text, coalesce(nullif(u, ''), 'manual://' || q) AS source_url, CASE q WHEN 'sharechat' THEN 'sharechat' ELSE 'twitter' END AS platform FROM n WHERE length(text) >= 10",
        "csv_import_counts": f"SELECT count(*) AS read, count(*) FILTER (length({_NFC}({_strip('text')})) >= 10) AS kept, count(*) FILTER (coalesce(length({_NFC}({_strip('text')})), 0) < 10) AS skipped FROM raw_sentences",
        "text_import": f"SELECT t AS text, 'manual://sharechat' AS source_url, 'sharechat' AS platform FROM (SELECT {_NFC}({_strip("regexp_replace(text, '[\\r\\n]+', ' ', 'g')")}) AS t FROM raw_sentences WHERE text IS NOT NULL) WHERE length(t) >= 10 AND t NOT LIKE '#%'",
        "jsonl_merge": "WITH r AS (SELECT * FROM raw_sentences WHERE sentence_id IS NOT NULL AND platform IN ('sharechat', 'twitter') QUALIFY row_number() OVER (PARTITION BY sentence_id ORDER BY CASE platform WHEN 'sharechat' THEN 0 ELSE 1 END, seq) = 1) SELECT sentence_id, text, platform, strftime(coalesce(collected_at, TIMESTAMP '1970-01-01'), '%Y-%m-%dT%H:%M:%SZ') AS collected_at FROM r",
        "parquet_test_split": f"WITH {_A} SELECT sentence_id, sentiment, coalesce(len(ner_spans), 0)::INT AS spans FROM a WHERE split = 'test'",
        "annotation_tasks": f"WITH {_R} SELECT sentence_id, text, strftime(collected_at, '%Y-%m-%dT%H:%M:%SZ') AS collected_at FROM r",
        "platform_proportions": f"SELECT {_PLAT} AS platform, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6)::DOUBLE AS share FROM raw_sentences GROUP BY 1",
        "corpus_statistics": f"WITH d AS (SELECT coalesce(split, 'none') AS s, coalesce({_PLAT}, 'none') AS p, coalesce(len({_toks('text')}), 0) AS t, coalesce(len(ner_spans), 0) > 0 AS e, coalesce(len(toxicity_labels), 0) > 0 AS x, sentiment FROM annotated_sentences) {cube} FROM d GROUP BY CUBE (s, p)",
        "entity_statistics": "SELECT split, p.entity_type AS entity_type, count(*) AS n FROM (SELECT split, unnest(ner_spans) AS p FROM annotated_sentences) GROUP BY ALL",
        "language_statistics": "SELECT split, t.label AS label, count(*) AS n FROM (SELECT split, unnest(token_language_labels) AS t FROM annotated_sentences) GROUP BY ALL",
        "daily_exposure": f"WITH {events} SELECT annotator_id, strftime(ts, '%Y-%m-%d') AS day, sum(n)::BIGINT AS exposure, sum(n) < 200 AS allowed FROM l WHERE kind = 'expose' GROUP BY 1, 2",
        "open_assignments": f"WITH {events}, {got} SELECT DISTINCT annotator_id, sentence_id FROM g WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.annotator_id = g.annotator_id AND (o.ts, o.event_id) >= (g.ts, g.event_id))",
        "replacement_queue": f"WITH {events}, {got}, {released}, b AS (SELECT sentence_id, max((ts, event_id)) AS gone FROM l WHERE kind = 'reassign' GROUP BY 1), q AS (SELECT rel.sentence_id, min(due) AS due FROM rel LEFT JOIN b USING (sentence_id) WHERE due IS NOT NULL AND (gone IS NULL OR due > gone) GROUP BY 1) SELECT sentence_id, strftime(due[1], '%Y-%m-%d %H:%M:%S.%f') AS ts FROM q",
        "search_query": """SELECT '("Maru Ekta" OR #rajasthan OR "a b" OR म्हारो) -is:retweet' AS query""",
        "page_posts": f"SELECT doc_id AS page_id, 0 AS place, length(regexp_replace(text, '{_WS}+', '', 'g'))::INT AS characters FROM documents WHERE text IS NOT NULL AND doc_id % 10 <> 0 AND NOT regexp_matches(lower(substring('menu' || chr(10) || {_TIDY}, 1, 500)), '404|not found|error|403|forbidden|500|502|503|service unavailable') AND length(trim(regexp_replace(text, '{_WS}+', ' ', 'g'))) >= 10",
    }
