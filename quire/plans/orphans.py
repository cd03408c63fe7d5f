"""Queries of problem 4, with SQL that resolves the references and checks them by plain joins."""

from __future__ import annotations

from quire.operators import references as R
from quire.plans.queries import ORACLES, QUERIES

_ATTRIBUTE = r"""(?is)<a\b[^>]*?\shref\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))"""
_UNESCAPED = "{}"
for _entity, _sign in (("&#0*39;|&#[xX]0*27;|&apos;", "chr(39)"), ("&#0*34;|&#[xX]0*22;|&quot;", "chr(34)"), ("&#0*32;|&#[xX]0*20;", "' '"), ("&lt;|&#0*60;|&#[xX]0*3[cC];", "'<'"), ("&gt;|&#0*62;|&#[xX]0*3[eE];", "'>'"), ("&amp;|&#0*38;|&#[xX]0*26;", "'&'")):
    _UNESCAPED = f"regexp_replace({_UNESCAPED}, '{_entity}', {_sign}, 'g')"


def _decoded(text: str) -> str:
    """Percent escapes decoded; text with a broken one is kept."""
    return f"(CASE WHEN contains({text}, '%') AND NOT regexp_matches({text}, '%([^0-9A-Fa-f]|[0-9A-Fa-f][^0-9A-Fa-f]|[0-9A-Fa-f]?$)') THEN url_decode(replace({text}, '+', '%2B')) ELSE {text} END)"


_FOLDED = (
    "array_to_string(list_reduce(list_transform(string_split({}, '/'), lambda p: [p]), lambda done, p: "
    "CASE WHEN p[1] IN ('.', '') THEN done WHEN p[1] = '..' THEN done[1 : len(done) - 1] ELSE list_concat(done, p) END, []::VARCHAR[]), '/')"
)

_REFERENCES = f"""(WITH base AS (SELECT doc_id, min(path) AS base FROM novel_files WHERE doc_id IS NOT NULL GROUP BY doc_id),
 raw AS (SELECT 'toc' AS ref_table, ref_id, doc_id, seen_at AS t, CASE WHEN regexp_matches(li_html, '{_ATTRIBUTE}') THEN {_UNESCAPED.format(" || ".join(f"regexp_extract(li_html, '{_ATTRIBUTE}', {g})" for g in (1, 2, 3)))} END AS href FROM toc
  UNION ALL SELECT 'hrefs', ref_id, doc_id, seen_at, href FROM hrefs),
 cleaned AS (SELECT ref_table, ref_id, t, base, regexp_replace(regexp_replace(href, '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g'), '[\\t\\n\\r]', '', 'g') AS clean FROM raw LEFT JOIN base ON raw.doc_id = base.doc_id),
 parted AS (SELECT *, split_part(clean, '#', 1) AS address, CASE WHEN contains(clean, '#') THEN regexp_replace(clean, '^[^#]*#', '') END AS hash FROM cleaned),
 plained AS (SELECT *, nullif({_decoded("hash")}, '') AS fragment, replace(split_part(address, '?', 1), chr(92), '/') AS plain FROM parted),
 placed AS (SELECT *, regexp_matches(plain, '(?i)^(https?:)?//') AS absolute, regexp_replace(CASE WHEN regexp_matches(plain, '(?i)^(https?:)?//') THEN regexp_replace(plain, '(?i)^(https?:)?//[^/]*', '') ELSE plain END, '(?i)%2e', '.', 'g') AS dotted FROM plained),
 whole AS (SELECT *, CASE WHEN absolute OR starts_with(dotted, '/') THEN dotted ELSE regexp_replace(base, '[^/]*$', '') || dotted END AS long FROM placed),
 folded AS (SELECT *, {_FOLDED.format("long")} AS short FROM whole)
 SELECT DISTINCT ref_table, ref_id, t, CASE WHEN plain = '' THEN base ELSE {_decoded("short")} END AS path, fragment AS link FROM folded
 WHERE CASE WHEN absolute THEN regexp_matches(plain, '(?i)^(https?:)?//library\\.example(:(80|443)?)?(/|$)') ELSE NOT regexp_matches(plain, '^[a-zA-Z][a-zA-Z0-9+.-]*:') END
  AND (fragment IS NULL OR regexp_matches(fragment, '^calibre_link-[0-9]+$')) AND CASE WHEN plain = '' THEN fragment IS NOT NULL OR contains(address, '?') ELSE ends_with({_decoded("plain")}, '.html') END
 UNION SELECT 'catalogue', ref_id, listed_at, {_FOLDED.format("replace(trim(path), chr(92), '/')")}, NULL FROM catalogue WHERE path LIKE '%.html%' AND ends_with(trim(path), '.html'))"""

_ORPHANS = f"""(SELECT ref_table, ref_id, t FROM {_REFERENCES} r WHERE NOT EXISTS (SELECT 1 FROM novel_files f WHERE f.path = r.path AND f.fetched_at <= r.t AND (f.removed_at IS NULL OR f.removed_at > r.t)
 AND (r.link IS NULL OR r.link = '{R.WRAPPER}' OR EXISTS (SELECT 1 FROM sections s WHERE s.doc_id = f.doc_id AND s.link_id = r.link AND s.added_at <= r.t AND (s.removed_at IS NULL OR s.removed_at > r.t)))))"""

QUERIES["p4_found"] = R.p4_found
QUERIES["p4_report"] = R.p4_report
ORACLES["p4_found"] = f"SELECT DISTINCT ref_table, ref_id FROM {_ORPHANS}"
ORACLES["p4_report"] = f"SELECT ref_table, strftime(t, '%Y-%m') AS month, count(DISTINCT ref_id) AS orphans FROM {_ORPHANS} GROUP BY 1, 2"
