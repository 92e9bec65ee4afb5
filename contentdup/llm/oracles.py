"""The license, manifest and divergence queries in SQL, for DuckDB."""

from __future__ import annotations

from contentdup.llm.licenses import DOUBT, PHRASES, TEMPLATES, Either, Gap, mandatory_words, parse_template

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lowered(column: str) -> str:
    return f"translate({column}, '{_UPPER}', '{_LOWER}')"


# Licenses: words joined by single blanks, templates as regular expressions.


def _regex(items: list) -> str:
    """Every word with a blank before it."""
    parts = []
    for item in items:
        if isinstance(item, list):
            parts.append(f"(?:{_regex(item)})?")
        elif isinstance(item, Gap):
            parts.append(f"(?: [^ ]+){{{item.low},{item.high}}}")
        elif isinstance(item, Either):
            parts.append("(?:" + "|".join("".join(f" {w.decode()}" for w in wording) for wording in item.wordings) + ")")
        else:
            parts.append(f" {item.decode()}")
    return "".join(parts)


def licenses_sql(templates: dict[str, list[str]] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> str:
    places, labels, scores = [], [], []
    for phrase in phrases:
        tests = " AND ".join(f"words[i + {k}] = '{word}'" for k, word in enumerate(phrase.split()))
        places.append(f"list_filter(range(1, len(words) + 1), lambda i: {tests})")
    for number, (phrase, label) in enumerate(phrases.items()):
        found = f"len(places[{number + 1}]) > 0"
        labels.append((found, label))
        scores.append((found, len(phrase.split())))
    base = [f"CASE WHEN {test} THEN '{label}' END" for test, label in labels]
    for label, variants in templates.items():
        for template in variants:
            items = parse_template(template)
            found = f"regexp_matches(line, '{_regex(items)} ')"
            labels.append((found, label))
            scores.append((found, mandatory_words(items)))
    every = [f"CASE WHEN {test} THEN '{label}' END" for test, label in labels]
    points = [f"CASE WHEN {test} THEN {m} / {m + DOUBT}::DOUBLE ELSE 0 END" for test, m in scores]

    def shown(cases):
        return f"array_to_string(list_sort(list_distinct(list_filter([{', '.join(cases)}], lambda x: x IS NOT NULL))), ',')"

    return f"""
        WITH split AS (
            SELECT doc_id, regexp_extract_all({_lowered("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words
            FROM documents
        ), found AS (
            SELECT doc_id, words, ' ' || array_to_string(words, ' ') || ' ' AS line, [{", ".join(places)}] AS places FROM split
        )
        SELECT doc_id, len(words)::BIGINT AS n_words, len(flatten(places))::BIGINT AS n_base,
               (list_min(flatten(places)) - 1)::BIGINT AS first_word, (list_max(flatten(places)) - 1)::BIGINT AS last_word,
               {shown(base)} AS base_labels, {shown(every)} AS labels, greatest({", ".join(points)}) AS score
        FROM found
    """


# Manifest: one common table per level, for trees of a fixed largest height.


def _crc32(text: str) -> str:
    letters = f"list_transform(string_split({text}, ''), lambda ch: ascii(ch)::BIGINT)"
    step = "list_reduce([xor(s, b), 1, 1, 1, 1, 1, 1, 1, 1], lambda c, i: xor(c >> 1, 3988292384 * (c & 1)))"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {letters}), lambda s, b: {step}), 4294967295)"


def _field(value: str) -> str:
    return f"coalesce(strlen(({value})::VARCHAR) || ':' || ({value})::VARCHAR, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(v) for v in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _levels(name: str, nodes: str, height: int) -> str:
    """``name0`` to ``name{height}``: nodes with what stands left and right of
    them in their run; nothing of a tree beyond its lone top."""
    parts = []
    run = "PARTITION BY key, place // 8 ORDER BY place"
    for k in range(height + 1):
        source = (
            nodes
            if k == 0
            else f"""SELECT key, place // 8 AS place, sha256(string_agg(h, '' ORDER BY place)) AS h
                     FROM {name}{k - 1} WHERE n > 1 GROUP BY key, place // 8"""
        )
        parts.append(f"""{name}{k} AS (
            SELECT *, count(*) OVER (PARTITION BY key) AS n,
                   coalesce(string_agg(h, '') OVER ({run} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
                   coalesce(string_agg(h, '') OVER ({run} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
            FROM ({source}))""")
    tops = " UNION ALL ".join(f"SELECT key, h FROM {name}{k} WHERE n = 1" for k in range(height + 1))
    return ", ".join([*parts, f"{name}_top AS ({tops})"])


def manifest_sql(height: int = 7) -> str:
    steps, source = [], "leaves"
    for name, key, place in (("g", "key", "place"), ("t", "''", "top_place")):
        for k in range(height):
            new = f"{name}_fold{k}"
            steps.append(f"""{new} AS (
                SELECT s.* EXCLUDE (folded, proof),
                       CASE WHEN x.h IS NULL THEN s.folded ELSE sha256(x.l || s.folded || x.r) END AS folded,
                       s.proof || coalesce(x.l || x.r, '') AS proof
                FROM {source} s LEFT JOIN {name}{k} x ON x.n > 1 AND x.key = s.{key} AND x.place = s.{place} // {8**k})""")
            steps[-1] = steps[-1].replace("s.''", "''")
            source = new
    return f"""
        WITH hashed AS (
            SELECT doc_id, coalesce('+' || lang, '') AS key, {_leaf("text")} AS leaf,
                   CASE WHEN {_crc32("doc_id::VARCHAR")} % 3 = 0 THEN {_leaf(_lowered("text"))} ELSE {_leaf("text")} END AS altered
            FROM documents
        ), placed AS (
            SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM hashed
        ), {_levels("g", "SELECT key, place, leaf AS h FROM placed", height)},
        group_tops AS (SELECT key AS lang_key, h, row_number() OVER (ORDER BY key) - 1 AS top_place FROM g_top),
        {_levels("t", "SELECT '' AS key, top_place AS place, h FROM group_tops", height)},
        leaves AS (
            SELECT p.doc_id, p.leaf, p.key, p.place, q.top_place, q.h AS subroot, p.altered AS folded, '' AS proof
            FROM placed p JOIN group_tops q ON q.lang_key = p.key
        ), {", ".join(steps)}
        SELECT doc_id, leaf, subroot, (SELECT h FROM t_top) AS root, sha256(proof) AS proof_sha256, folded AS folded_root,
               folded = (SELECT h FROM t_top) AS verified
        FROM {source}
    """


# Divergence: all kept terms of all groups, priced in 128-bit integers.


def divergence_sql(min_docs: int = 10, top_terms: int = 10) -> str:
    price = "1 + (1000000000::HUGEINT * (coalesce({n}, 0) + 2)) // ({total} + 2 * n_terms)"
    return f"""
        WITH d AS (
            SELECT doc_id, row_number() OVER () AS row_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                   regexp_extract_all({_lowered("coalesce(text, '')")}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS words
            FROM documents
        ), w AS (
            SELECT lang, source, row_id, unnest(words) AS term FROM d
        ), kept AS (
            SELECT lang, term, count(*) AS lang_n FROM w GROUP BY ALL HAVING count(DISTINCT row_id) >= {min_docs}
        ), langs AS (
            SELECT lang, count(*) AS n_terms, sum(lang_n) AS lang_total FROM kept GROUP BY lang
        ), used AS (
            SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL
        ), groups AS (
            SELECT DISTINCT lang, source FROM d
        ), totals AS (
            SELECT lang, source, coalesce(sum(n), 0) AS total FROM groups LEFT JOIN used USING (lang, source) GROUP BY ALL
        ), priced AS (
            SELECT t.lang, t.source, k.term, u.n, {price.format(n="u.n", total="t.total")} AS p,
                   {price.format(n="k.lang_n", total="l.lang_total")} AS q
            FROM totals t JOIN kept k USING (lang) JOIN langs l USING (lang)
            LEFT JOIN used u ON u.lang = t.lang AND u.source = t.source AND u.term = k.term
        ), sums AS (
            SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
            FROM priced a JOIN priced b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
            GROUP BY ALL
        ), rows AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
            FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
            UNION ALL
            SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM priced WHERE n > 0 AND p > q
        )
        SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM rows
        QUALIFY part = 'pair' OR rank <= {top_terms}
    """
