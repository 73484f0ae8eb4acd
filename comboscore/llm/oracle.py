"""DuckDB statements for the numbered queries that SQL can express on whole tables in seconds."""

WORDS = r"'[^\x20\x09-\x0D]+'"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SUBSTRING_DEDUP = rf"""
WITH texts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {WORDS}) AS ws FROM documents),
words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM texts),
windows AS (SELECT doc_id, pos, md5(array_to_string(ws[pos:pos + 49], ' ')) AS seq
            FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS pos FROM texts WHERE len(ws) >= 50)),
firsts AS (SELECT seq, min(doc_id) AS first_id FROM windows GROUP BY seq HAVING min(doc_id) < max(doc_id)),
hits AS (SELECT doc_id, pos FROM windows JOIN firsts USING (seq) WHERE first_id < doc_id),
marked AS (SELECT w.doc_id, w.pos, w.word, coalesce(max(CASE WHEN h.pos IS NOT NULL THEN 1 END) OVER
             (PARTITION BY w.doc_id ORDER BY w.pos ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 0) AS gone
           FROM words w LEFT JOIN hits h ON w.doc_id = h.doc_id AND w.pos = h.pos),
kept AS (SELECT doc_id, count(*) AS n_words, sum(gone) AS n_removed,
           string_agg(word, ' ' ORDER BY pos) FILTER (WHERE gone = 0) AS kept_text FROM marked GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(kept_text, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (doc_id)
"""

NGRAM_JOIN = rf"""
WITH RECURSIVE texts AS (SELECT doc_id, regexp_extract_all({LOWER}, {WORDS}) AS ws FROM documents),
shingles AS (SELECT DISTINCT doc_id, md5(array_to_string(ws[pos:pos + 4], ' ')) AS s
             FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS pos FROM texts WHERE len(ws) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared
             FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM common JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y
          WHERE 100 * shared >= 80 * (a.n + b.n - shared)),
steps AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id, doc_id AS other FROM sizes
          UNION SELECT r.doc_id, s.y FROM reach r JOIN steps s ON s.x = r.other)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(least_id, doc_id) AS component_id
FROM texts LEFT JOIN sizes USING (doc_id)
     LEFT JOIN (SELECT doc_id, min(other) AS least_id FROM reach GROUP BY doc_id) USING (doc_id)
"""

# crc32 of a decimal number, one step a bit: every digit's byte is followed by seven zeros
CRC32 = """xor(list_reduce(list_prepend(4294967295::UBIGINT, flatten(list_transform(string_split({x}::VARCHAR, ''),
  lambda c: [ascii(c)::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT]))),
  lambda c, b: xor(xor(c, b) >> 1, 3988292384::UBIGINT * (xor(c, b) & 1::UBIGINT))), 4294967295::UBIGINT)"""

PREFIX_TRIE = f"""
WITH own AS (SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}}
               ORDER BY turn NULLS FIRST) AS turns FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
heads AS (SELECT conv_id, turns, ({CRC32.format(x="conv_id")} % 9)::INT AS h FROM own),
rebuilt AS (SELECT c.conv_id, list_concat(coalesce(o.turns, [])[1:c.h], c.turns[c.h + 1:]) AS turns
            FROM heads c LEFT JOIN own o ON o.conv_id = c.conv_id - c.conv_id % 5),
prefixes AS (SELECT conv_id, len(turns) AS whole, depth, turns[1:depth] AS node
             FROM (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS depth FROM rebuilt)),
hashed AS (SELECT conv_id, whole, depth, md5(to_json(node)::VARCHAR) AS node,
             CASE WHEN depth > 0 THEN md5(to_json(node[1:depth - 1])::VARCHAR) END AS parent,
             CASE WHEN depth > 0 THEN strlen(node[depth]['text']) ELSE 0 END AS bytes FROM prefixes),
nodes AS (SELECT node, any_value(parent) AS parent, any_value(depth) AS depth, any_value(bytes) AS bytes,
            min(conv_id) AS conv_id, count(*) AS n_convs,
            sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE whole = depth), '')) AS ends_sha256
          FROM hashed GROUP BY node),
children AS (SELECT parent AS node, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
counted AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN children USING (node)),
-- every node with each of its beginnings, found along its smallest member
above AS (SELECT h.node AS top, c.n_children, (c.n_convs - 1) * c.bytes AS saved
          FROM counted c JOIN hashed h ON h.conv_id = c.conv_id AND h.depth <= c.depth),
totals AS (SELECT top AS node, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved) AS saved_tokens
           FROM above GROUP BY top)
SELECT c.conv_id, c.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, c.n_convs::BIGINT AS n_convs,
       c.n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, c.ends_sha256
FROM counted c JOIN totals USING (node) LEFT JOIN counted p ON p.node = c.parent
"""

PHRASES = rf"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang,
                  unnest(string_split_regex({LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
totals AS (SELECT lang, sum(len(ws)) AS n FROM words GROUP BY lang),
counts AS (SELECT lang, k, array_to_string(ws[pos:pos + k - 1], ' ') AS phrase, count(*) AS f
           FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS pos
                 FROM words, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE len(ws) >= k) GROUP BY 1, 2, 3),
found AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM counts WHERE k >= 2 AND f >= 100),
cuts AS (SELECT c.lang, c.phrase, cut, a, l.f AS l, r.f AS r, n,
           (1000::HUGEINT * a * n) // (l.f::HUGEINT * r.f) AS score
         FROM (SELECT *, unnest(range(1, k)) AS cut FROM found) c JOIN totals USING (lang)
         JOIN counts l ON l.lang = c.lang AND l.k = cut AND l.phrase = array_to_string(ws[1:cut], ' ')
         JOIN counts r ON r.lang = c.lang AND r.k = c.k - cut AND r.phrase = array_to_string(ws[cut + 1:], ' ')),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inside AS (SELECT DISTINCT s.lang, s.phrase
           FROM (SELECT lang, k, a, ws, m, unnest(range(1, k - m + 2)) AS pos
                 FROM (SELECT *, unnest(range(2, k)) AS m FROM found)) b
           JOIN found s ON s.lang = b.lang AND s.phrase = array_to_string(b.ws[pos:pos + m - 1], ' ')
           WHERE 100 * b.a >= 100 * s.a),
ranked AS (SELECT lowest.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
           FROM lowest ANTI JOIN inside USING (lang, phrase))
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n,
       score::BIGINT AS score FROM ranked WHERE rank <= 2000
"""

ORACLE_SQL = {"op3_substring_dedup": SUBSTRING_DEDUP, "op8_ngram_join": NGRAM_JOIN, "op11_prefix_trie": PREFIX_TRIE,
              "op13_phrase_mining": PHRASES}
