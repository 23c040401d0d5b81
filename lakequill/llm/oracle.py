"""DuckDB texts of the operators that SQL can express, over whole tables."""

from __future__ import annotations

from lakequill.llm import licenses as L
from lakequill.llm import quality as Q
from lakequill.llm import secrets as S

_WORD = r"[^\x20\x09-\x0D]+"
#: The characters of each class; what is left is taken by difference.
_CHARS = {"lower": "[a-z]", "upper": "[A-Z]", "digit": "[0-9]", "stop": r"""[.,;:?''"()-]""", "mark": "[!]", "symbol": r"[#$%&*+/<=>@\[\\\]^_`{|}~]", "control": r"[\x00-\x08\x0E-\x1F\x7F]", "beyond": r"[^\x00-\x7F]"}


def quality_rules() -> str:
    """Base counts, histograms, mean distributions of each language in two rounds, distances and verdicts."""
    forms = ", ".join(f"('{form}', {slot})" for form, slot in sorted(Q.SLOT.items()))
    classes = ", ".join(f"({k}, len(regexp_extract_all(t, '{_CHARS[c]}')))" for k, c in enumerate(Q.CLASSES))
    other = len(Q.VOCABULARY)

    def references(name: str, source: str) -> str:
        return f"""
    {name} AS (SELECT d.lang, s.kind, s.slot, sum(s.share) / any_value(n.many) AS ref FROM {source} d JOIN shares s ON s.id = d.id
        JOIN (SELECT lang, count(*) AS many FROM {source} GROUP BY lang) n ON n.lang = d.lang GROUP BY d.lang, s.kind, s.slot),
    {name}_pairs AS (SELECT d.id, r.lang, g.kind, g.slot, coalesce(s.share, 0.0) AS p, coalesce(f.ref, 0.0) AS q FROM docs d
        JOIN (SELECT DISTINCT lang FROM {name}) r ON d.lang = r.lang OR d.lang IS NULL
        CROSS JOIN slots g LEFT JOIN shares s ON s.id = d.id AND s.kind = g.kind AND s.slot = g.slot
        LEFT JOIN {name} f ON f.lang = r.lang AND f.kind = g.kind AND f.slot = g.slot),
    {name}_far AS (SELECT id, lang, kind, sqrt(greatest(sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2, 0)) AS far FROM {name}_pairs GROUP BY id, lang, kind),
    {name}_both AS (SELECT id, lang, max(far) FILTER (kind = 'c') AS by_chars, max(far) FILTER (kind = 'w') AS by_words FROM {name}_far GROUP BY id, lang),
    {name}_near AS (SELECT id, arg_min(struct_pack(c := by_chars, w := by_words), (by_chars + by_words, lang)) AS m FROM {name}_both GROUP BY id),
    {name}_ok AS (SELECT d.id, (n_chars < {Q.CHARS_LEAST} OR m.c <= {Q.CHARS_BASE} + {Q.CHARS_SPREAD} / sqrt(greatest(n_chars, 1)))
        AND (n_words < {Q.WORDS_LEAST} OR m.w <= {Q.WORDS_BASE} + {Q.WORDS_SPREAD} / sqrt(greatest(n_words, 1))) AS ok FROM docs d JOIN {name}_near n ON n.id = d.id)"""

    return f"""
    WITH raw AS (SELECT row_number() OVER () AS id, doc_id, lang, coalesce(text, '') AS t FROM documents),
    words AS (SELECT id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM (SELECT id, regexp_extract_all(t, '{_WORD}') AS w FROM raw)),
    windows AS (SELECT id, pos, count(*) OVER (PARTITION BY id, word, w2, w3) AS n FROM (SELECT id, pos, word, lead(word, 1) OVER o AS w2, lead(word, 2) OVER o AS w3 FROM words WINDOW o AS (PARTITION BY id ORDER BY pos)) WHERE w3 IS NOT NULL),
    repeats AS (SELECT id, count(DISTINCT pos + k) AS n_repeat_words FROM windows CROSS JOIN (VALUES (0), (1), (2)) x(k) WHERE n > 1 GROUP BY id),
    totals AS (SELECT id, count(*) AS n_words, cast(sum(length(word)) AS bigint) AS word_chars FROM words GROUP BY id),
    lines AS (SELECT id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS l FROM raw),
    counts AS (SELECT r.id, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines FROM raw r JOIN lines USING (id)),
    chars AS (SELECT id, c.slot, c.n FROM raw, LATERAL (SELECT * FROM (VALUES {classes}) v(slot, n)) c),
    docs AS (SELECT r.id, doc_id, lang, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, n_symbols, n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, n_chars
        FROM raw r LEFT JOIN totals USING (id) LEFT JOIN counts USING (id) LEFT JOIN repeats USING (id) JOIN (SELECT id, sum(n) AS n_chars FROM chars GROUP BY id) USING (id)),
    forms(form, slot) AS (VALUES {forms}),
    hits AS (SELECT id, slot, count(*) AS n FROM words JOIN forms ON form = word GROUP BY id, slot),
    shares AS (SELECT c.id, 'c' AS kind, c.slot, c.n / greatest(d.n_chars, 1) AS share FROM chars c JOIN docs d ON d.id = c.id
        UNION ALL SELECT h.id, 'w', h.slot, h.n / greatest(d.n_words, 1) FROM hits h JOIN docs d ON d.id = h.id
        UNION ALL SELECT d.id, 'w', {other}, (d.n_words - coalesce(k.n, 0)) / greatest(d.n_words, 1) FROM docs d LEFT JOIN (SELECT id, sum(n) AS n FROM hits GROUP BY id) k ON k.id = d.id),
    slots AS (SELECT 'c' AS kind, range AS slot FROM range({len(Q.CLASSES)}) UNION ALL SELECT 'w', range FROM range({other + 1})),
    long AS (SELECT * FROM docs WHERE n_chars >= {Q.CHARS_LEAST} AND n_words >= {Q.WORDS_LEAST}),
    usable AS (SELECT * FROM long WHERE lang IN (SELECT lang FROM long GROUP BY lang HAVING count(*) >= {Q.LEAST_ROWS})),
    {references("one", "usable").strip()},
    within AS (SELECT u.* FROM usable u JOIN one_ok o ON o.id = u.id WHERE ok),
    {references("two", "within").strip()}
    SELECT d.doc_id, d.n_words, d.word_chars, d.n_symbols, d.n_dup_lines, d.n_repeat_words,
        (d.n_words < {Q.FEWEST_WORDS} OR 100 * d.n_repeat_words > {Q.MOST_REPEATED} * d.n_words) AS base_failed,
        NOT (d.n_words < {Q.FEWEST_WORDS} OR 100 * d.n_repeat_words > {Q.MOST_REPEATED} * d.n_words) AND coalesce(k.ok, true) AS kept
    FROM docs d LEFT JOIN two_ok k ON k.id = d.id"""


def licenses() -> str:
    """Lines with a cue as sparse vectors, cosines to the templates, best line, nearest licence file above."""
    idf, unknown, rows = L.template_vectors()
    quote = lambda s: s.replace("'", "''")
    weights = ", ".join(f"('{quote(n)}', '{quote(t)}', {w!r}::DOUBLE)" for n, t, w in rows)
    frequencies = ", ".join(f"('{quote(t)}', {w!r}::DOUBLE)" for t, w in idf.items())
    cue = quote(L.CUE)
    words = lambda x: f"len(regexp_extract_all({x}, '{_WORD}'))"
    # Sentence ends and term edges are marked first: this engine's patterns have no look-around.
    lines = r"string_split(regexp_replace(t, '([.!?])\s+(\p{Lu})', '\1' || chr(10) || '\2', 'g'), chr(10))"
    terms = r"regexp_split_to_array(regexp_replace(regexp_replace(lower(line) || ' ', '\.(\s)', ' \1', 'g'), '[.,]([^0-9])', ' \1', 'g'), '[^a-z0-9.+-]+')"
    return rf"""
    WITH templates(template, term, weight) AS (VALUES {weights}), frequencies(term, idf) AS (VALUES {frequencies}),
    docs AS (SELECT doc_id, concat_ws('/', source, lang, doc_id) AS path, concat_ws('/', source, lang) AS dir, coalesce(text, '') AS t FROM documents),
    lines AS (SELECT path, {words('t')} AS n, line, pos FROM (SELECT path, t, unnest({lines}) AS line, generate_subscripts({lines}, 1) AS pos FROM docs WHERE regexp_matches(t, '{cue}')) WHERE regexp_matches(line, '{cue}')),
    terms AS (SELECT path, n, pos, {words('line')} AS words, unnest(list_filter({terms}, lambda x: x <> '')) AS term FROM lines),
    tf AS (SELECT path, n, pos, words, term, count(*) AS tf FROM terms GROUP BY ALL),
    weighed AS (SELECT tf.*, tf * coalesce(idf, {unknown!r}::DOUBLE) AS w FROM tf LEFT JOIN frequencies f ON f.term = tf.term),
    norms AS (SELECT path, n, pos, words, sqrt(sum(w * w)) AS norm FROM weighed GROUP BY ALL),
    dots AS (SELECT path, pos, template, sum(w * weight) AS dot FROM weighed x JOIN templates t ON t.term = x.term GROUP BY ALL),
    scored AS (SELECT n.*, template, round(dot / norm, 6) AS cosine FROM norms n JOIN dots d ON d.path = n.path AND d.pos = n.pos WHERE round(dot / norm, 6) >= {L.LEAST_COSINE}),
    best AS (SELECT path, n, pos, words, max((cosine, template)) AS hit FROM scored GROUP BY ALL),
    own AS (SELECT path, max(hit)[1] AS cosine, split_part(max(hit)[2], '#', 1) AS license, sum(words) / max(n) AS cover FROM best GROUP BY path),
    files AS (SELECT dir, max((cosine, license))[2] AS license FROM own JOIN docs USING (path) WHERE cover >= {L.LEAST_SHARE} GROUP BY dir)
    SELECT d.doc_id, coalesce(o.license, f.license) AS license, o.cosine, (o.license IS NULL AND f.license IS NOT NULL) AS inherited
    FROM docs d LEFT JOIN own o ON o.path = d.path LEFT JOIN files f ON f.dir = d.dir"""


def secrets() -> str:
    """Spans of the patterns by running lengths of pieces and matches, and the battery over other long runs."""
    quote = lambda s: s.replace("'", "''")

    def matches(rank: int, pattern: str) -> str:
        return f"""SELECT id, {rank} AS rank, m[i] AS found, cast(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS bigint) AS start
            FROM (SELECT id, g, m, unnest(range(1, len(m) + 1)) AS i FROM (SELECT id, string_split_regex(t, '{quote(pattern)}') AS g, regexp_extract_all(t, '{quote(pattern)}') AS m FROM docs WHERE regexp_matches(t, '{quote(pattern)}')))"""

    alphabets = " ".join(f"WHEN regexp_matches(found, '{p}') THEN '{a}'" for _, p, a in S.ALPHABETS if p)
    tables = ", ".join(f"('{a}', {list(S.ratios(a))}::INTEGER[])" for _, _, a in S.ALPHABETS)
    kinds = " ".join(f"WHEN {k} THEN '{name}'" for k, name in enumerate(S.KINDS))
    listed = f"coalesce(string_agg(CASE rank {kinds} END || ':' || start || ':' || stop, ',' ORDER BY start, rank, stop)"
    tail = lambda z: f"(1 / (1 + exp(greatest(-700, least(700, {S.TAIL[0]} * ({z}) + {S.TAIL[1]} * ({z}) * ({z}) * ({z}))))))"
    cauchy = " + ".join(f"tan((0.5 - least(0.99, greatest(1e-12, {p}))) * pi())" for p in ("squares_p", "runs_p", "serial_p"))

    def rejected(p: str, level: float) -> str:
        return f"""SELECT id, start FROM (SELECT *, max(CASE WHEN w <= i * {level} / many THEN i ELSE 0 END) OVER (PARTITION BY id) AS last FROM (
            SELECT *, row_number() OVER (PARTITION BY id ORDER BY w, start, stop) AS i FROM (SELECT *, {p} * total / many / n AS w FROM judged))) WHERE i <= last"""

    return f"""
    WITH docs AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS t FROM documents),
    ratios(alphabet, ratio) AS (VALUES {tables}),
    raw AS ({matches(0, S.ASSIGN)} UNION ALL {matches(1, S.ACCESS)} UNION ALL {matches(2, S.HEX)}),
    base AS (SELECT id, rank, start, start + length(found) AS stop FROM raw WHERE rank > 0 OR length(regexp_extract(found, '{quote(S.ASSIGN)}', 2)) >= {S.ASSIGN_LEAST}),
    runs AS (SELECT r.id, found, start, start + length(found) AS stop, length(found)::DOUBLE AS n, CASE {alphabets} ELSE '{S.ALPHABETS[-1][2]}' END AS alphabet FROM ({matches(3, S.RUN)}) r
        WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.id = r.id AND b.start < r.start + length(found) AND r.start < b.stop)),
    signs AS (SELECT id, start, n, length(alphabet)::DOUBLE AS k, unnest(range(1, length(found) + 1)) AS pos, CASE WHEN length(alphabet) = 64 THEN translate(found, '-_', '+/') ELSE found END AS f, alphabet FROM runs),
    v AS (SELECT id, start, n, k, pos, alphabet, (instr(alphabet, f[pos]) - 1)::DOUBLE AS v, lead(instr(alphabet, f[pos]) - 1) OVER (PARTITION BY id, start ORDER BY pos)::DOUBLE AS w FROM signs),
    squares AS (SELECT id, start, sum(c * c)::DOUBLE AS squares FROM (SELECT id, start, v, count(*) AS c FROM v GROUP BY id, start, v) GROUP BY id, start),
    likely AS (SELECT id, start, sum(ratio[cast(v * k + w AS integer) + 1])::DOUBLE AS ratio FROM v JOIN ratios r ON r.alphabet = v.alphabet WHERE w IS NOT NULL GROUP BY id, start),
    means AS (SELECT id, start, any_value(n) AS n, any_value(k) AS k, avg(v) AS mean, count(*) FILTER (v > (k - 1) / 2)::DOUBLE AS high, count(*) FILTER ((v > (k - 1) / 2) <> (w > (k - 1) / 2)) + 1 AS changes FROM v GROUP BY id, start),
    serial AS (SELECT v.id, v.start, sum((v - mean) * (v - mean)) AS variance, sum((v - mean) * (w - mean)) AS joint FROM v JOIN means m ON m.id = v.id AND m.start = v.start GROUP BY v.id, v.start),
    scaled AS (SELECT m.id, m.start, m.start + m.n::BIGINT AS stop, n, exp(least(0, -ratio / 100)) AS ordinary,
        (cbrt((squares * k / n - n) / (k - 1)) - 1 + (n - 1) / (n * (k - 1) * 4.5)) / sqrt((n - 1) / (n * (k - 1) * 4.5)) AS squares_z,
        abs((changes - 1 - 2 * high * (n - high) / n) / sqrt(greatest(0.25, 2 * high * (n - high) * (2 * high * (n - high) - n) / (n * n * (n - 1))))) AS runs_z,
        abs((CASE WHEN variance > 0 THEN joint / variance ELSE 1 END + 1 / n) * n * sqrt(n - 1) / (n - 2)) AS serial_z
        FROM means m JOIN squares q ON q.id = m.id AND q.start = m.start JOIN serial s ON s.id = m.id AND s.start = m.start JOIN likely l ON l.id = m.id AND l.start = m.start),
    tested AS (SELECT *, {tail('squares_z')} AS squares_p, 2 * {tail('runs_z')} AS runs_p, 2 * {tail('serial_z')} AS serial_p FROM scaled),
    judged AS (SELECT *, 0.5 - atan(({cauchy}) / 3) / pi() AS random, sum(n) OVER (PARTITION BY id) AS total, count(*) OVER (PARTITION BY id) AS many FROM tested),
    odd AS ({rejected('ordinary', S.LEVEL)}),
    even AS ({rejected('random', S.REJECTED)}),
    found AS (SELECT j.id, 3 AS rank, j.start, j.stop FROM judged j JOIN odd o ON o.id = j.id AND o.start = j.start ANTI JOIN even e ON e.id = j.id AND e.start = j.start),
    b AS (SELECT id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex, {listed}, '') AS spans FROM base GROUP BY id),
    a AS (SELECT id, {listed}, '') AS spans FROM (SELECT * FROM base UNION ALL SELECT * FROM found) GROUP BY id)
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(b.spans, '')) AS base_sha256, coalesce(a.spans, '') AS spans
    FROM docs LEFT JOIN b ON b.id = docs.id LEFT JOIN a ON a.id = docs.id"""


def ngram_jaccard(percent: int = 90) -> str:
    """All pairs of rows that share a shingle, their links, and what links reach."""
    return f"""
    WITH RECURSIVE docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w FROM documents),
    sets AS (SELECT r, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END)) AS s FROM docs),
    sizes AS (SELECT r, count(*) AS n FROM sets GROUP BY r),
    pairs AS (SELECT a.r AS x, b.r AS y, count(*) AS c FROM sets a JOIN sets b ON a.s = b.s AND a.r < b.r GROUP BY a.r, b.r),
    linked AS (SELECT x, y FROM pairs JOIN sizes a ON a.r = x JOIN sizes b ON b.r = y WHERE 100 * c >= {percent} * (a.n + b.n - c)),
    edges AS (SELECT x, y FROM linked UNION ALL SELECT y, x FROM linked),
    reach(r, other) AS (SELECT r, r FROM docs UNION SELECT reach.r, y FROM reach JOIN edges ON x = other),
    components AS (SELECT reach.r, min(d.doc_id) AS component_id FROM reach JOIN docs d ON d.r = other GROUP BY reach.r),
    counts AS (SELECT x AS r, count(*) AS n_links FROM edges GROUP BY x)
    SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, coalesce(n_links, 0) AS n_links
    FROM docs JOIN components USING (r) LEFT JOIN sizes USING (r) LEFT JOIN counts USING (r)"""


def top_k(k: int = 10, dimensions: int = 64) -> str:
    """All distances of every asked code to every code."""
    return f"""
    WITH codes AS (SELECT vec_id, list_transform(range(1, {dimensions + 1}), lambda i: CASE WHEN embedding[i] > 0 THEN 1 ELSE 0 END) AS b FROM embeddings WHERE embedding IS NOT NULL),
    far AS (SELECT q.vec_id AS query_id, v.vec_id, cast(list_sum(list_transform(range(1, {dimensions + 1}), lambda i: abs(q.b[i] - v.b[i]))) AS integer) AS distance FROM codes q, codes v WHERE q.vec_id % 50 = 0)
    SELECT query_id, cast(rank AS integer) AS rank, vec_id, distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM far) WHERE rank <= {k}"""
