"""DuckDB SQL for the catalogue: written by itself, from the same fixed values, to check the Spark queries against."""

from __future__ import annotations

from ..functions import constants as C
from . import fixtures as D


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def clean(c: str) -> str:
    return f"lower(trim({strip(c)}, {q(C.ADDRESS_EDGES)}))"


def among(c: str, values: list[str]) -> str:
    return f"{c} in ({', '.join(map(q, values))})"


def prefixed(c: str, prefixes: list[str]) -> str:
    return "(" + " or ".join(f"starts_with({c}, {q(p)})" for p in prefixes) + ")"


def found(c: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all({c}, {q(pattern)}, {group})"


def listed(c: str) -> str:
    return f"coalesce(array_to_string({c}, '|'), '')"


def each(blocks: str, one: str) -> str:
    """one: SQL in terms of x."""
    return f"flatten(list_transform({blocks}, lambda x: {one}))"


PAGES = D.values(D.PAGES, "page_id, domain, url, html")
_OUTSIDE = f"(?i)/?(?:{C.EMAIL.removeprefix('(?i)')})"


def outside(c: str) -> str:
    return f"list_filter({found(c, _OUTSIDE)}, lambda y: not starts_with(y, '/'))"


LOCAL, DOMAIN = "left({0}, length({0}) - length(split_part({0}, '@', -1)) - 1)", "split_part({0}, '@', -1)"


def syntax(a: str) -> str:
    return f"(length({a}) > 0 and length({a}) <= 320 and length({LOCAL.format(a)}) <= 64 and regexp_matches({a}, {q(C.EMAIL_SYNTAX)}))"


def domain_ok(d: str) -> str:
    label = r"^[a-zA-Z0-9\-]{1,63}$"
    return f"""(length({d}) between 1 and 253 and contains({d}, '.') and length(split_part({d}, '.', -1)) >= 2
      and len(list_filter(string_split({d}, '.'), lambda l: not (regexp_matches(l, {q(label)}) and not starts_with(l, '-') and not ends_with(l, '-')))) = 0)"""


def validated(source: str, keep: str, mx: bool = False) -> str:
    """source: relation with ``address``; with mx also mx_ok, resolves, smtp_known."""
    a, d = "a", DOMAIN.format("a")
    facts = "mx_ok, resolves, smtp_known" if mx else "true as mx_ok, null::boolean as resolves, null::boolean as smtp_known"
    return f"""
    (with s0 as (select *, lower({strip("address")}) as a, {facts} from {source}),
    s1 as (select *, {syntax(a)} as is_valid_syntax from s0),
    s2 as (select *, is_valid_syntax and {domain_ok(d)} as is_valid_domain from s1),
    s3 as (select * exclude (smtp_known), is_valid_domain and coalesce(mx_ok, false) as mx_valid,
      is_valid_domain and {among(d, C.DISPOSABLE_DOMAINS + C.PLACEHOLDER_DOMAINS)} as is_disposable,
      is_valid_domain and {among(LOCAL.format(a), C.ROLE_PREFIXES)} as is_role_based, smtp_known from s2),
    s4 as (select *, case when mx_valid then smtp_known end as smtp_valid from s3),
    s5 as (select *, 70 - case when is_role_based then 15 else 0 end + case when smtp_valid then 10 else 0 end + case when {str(mx).lower()} and mx_valid then 15 else 0 end as t0 from s4),
    s6 as (select *, case when {str(mx).lower()} and not mx_valid then greatest(t0 - 20, 0) else t0 end as t1 from s5),
    s7 as (select *, case when smtp_valid = false then greatest(t1 - 25, 0) else t1 end as t2 from s6),
    s8 as (select *, case when not is_valid_syntax then 0 when not is_valid_domain then 5 when is_disposable then least(t2, 20) else least(t2, 100) end::int as validation_score from s7)
    select {keep}, is_valid_syntax, is_valid_domain, mx_valid, smtp_valid, is_disposable, is_role_based, validation_score,
      case when not is_valid_domain or is_disposable or smtp_valid = false then 'invalid' when mx_valid and validation_score >= 60 then 'valid' when validation_score >= 40 then 'uncertain' else 'invalid' end as validation_status,
      nullif(array_to_string(list_filter([case when not is_valid_syntax then 'Failed syntax check' end, case when is_valid_syntax and not is_valid_domain then 'Invalid domain format' end,
        case when is_valid_domain and resolves = false then 'DNS resolution failed' end, case when is_valid_domain and not mx_valid then 'No MX record' end, case when smtp_valid = false then 'SMTP rejected' end,
        case when is_disposable then 'Disposable email domain' end, case when is_role_based then 'Role-based address' end], lambda n: n is not null), '; '), '') as notes from s8)"""


DOC_EMAILS = f"""(select source, doc_id, i - 1 as match_no, {clean("f[i]")} as address from
    (select source, doc_id, {found("text", C.EMAIL)} as f from documents), range(1, 10000) r(i) where i <= len(f))"""
FIRST = f"""(select * from (select *, row_number() over (partition by source, address order by doc_id, match_no) as rn from {DOC_EMAILS}) where rn = 1)"""


def method_base(c: str) -> str:
    return "case " + " ".join(f"when {c} = {q(m)} then {v}" for m, v in C.METHOD_BASE.items()) + f" else {C.OTHER_METHOD_BASE} end"


def visible(c: str) -> str:
    out = rf"regexp_replace({c}, '(?s)<!--.*?-->', ' ', 'g')"
    for tag in ("script", "style", "noscript"):
        out = rf"regexp_replace({out}, '(?is)<{tag}[^>]*>.*?</{tag}>', ' ', 'g')"
    return tags_off(out)


# written here on its own: the names that the tables and the fixtures use, and how references look
_NAMES = {"amp": 38, "lt": 60, "gt": 62, "quot": 34, "apos": 39, "nbsp": 160, "copy": 169, "middot": 183, "eacute": 233, "mdash": 8212, "commat": 64}
_NAMED = "map {" + ", ".join(f"'{k}': {v}" for k, v in _NAMES.items()) + "}"
_REFERENCE = "&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|(?:amp|lt|gt|quot|nbsp|copy|middot|eacute);?|(?:mdash|apos|commat);)"
_WINDOWS = "map {" + ", ".join(f"{n}: {ord(bytes([n]).decode('cp1252'))}" for n in range(128, 160) if n not in (129, 141, 143, 144, 157)) + "}"
_DIGITS = "list_transform(range(4, length(ref) + 1), lambda pos: strpos('0123456789abcdef', lower(substr(ref, pos, 1))) - 1)"


def unescape(c: str) -> str:
    """Character by character reference: by name, or by number in base 10 or 16."""
    ten = "try_cast(regexp_extract(ref, '^&#([0-9]+)', 1) as int)"
    sixteen = f"list_reduce(list_prepend(0, list_filter({_DIGITS}, lambda dg: dg >= 0)), lambda num, dg: num * 16 + dg)"
    code = f"coalesce({_NAMED}[trim(ref, '&;')], {ten}, case when regexp_matches(ref, '^&#[xX]') then {sixteen} end)"
    known = f"list_filter(list_transform(list_distinct({found(c, _REFERENCE)}), lambda ref: {{'r': ref, 'n': {code}}}), lambda hit: hit.n is not null)"
    chars = f"list_transform({known}, lambda hit: {{'r': hit.r, 'c': chr((case when hit.n = 0 or hit.n > 1114111 or hit.n between 55296 and 57343 then 65533 else coalesce({_WINDOWS}[hit.n], hit.n) end)::int)}})"
    order = f"list_sort(list_transform({chars}, lambda hit: {{'last': hit.c = '&', 'size': -length(hit.r), 'r': hit.r, 'c': hit.c}}))"
    first = f"{{'last': false, 'size': 0::bigint, 'r': '', 'c': {c}}}"
    return f"list_reduce(list_prepend({first}, {order}), lambda acc, hit: {{'last': acc.last, 'size': acc.size, 'r': acc.r, 'c': replace(acc.c, hit.r, hit.c)}}).c"


def tags_off(c: str) -> str:
    untagged = f"regexp_replace({c}, '(?s)<[^>]*>', ' ', 'g')"
    return strip(rf"regexp_replace({unescape(untagged)}, '\s+', ' ', 'g')")


def section(c: str, tag: str, most: int) -> str:
    opening = q(rf"""(?is)<([a-z][a-z0-9]*)\s[^>]*class\s*=\s*["'][^"'>]*{tag}[^>]*>""")
    named = f"regexp_extract({c}, '(?is)<{tag}[^>]*>(.*?)</{tag}>', 1)"
    start, kind = f"regexp_extract({c}, {opening}, 0)", f"regexp_extract({c}, {opening}, 1)"
    classed = f"split_part(substr({c}, strpos({c}, {start}) + length({start})), '</' || {kind}, 1)"
    return f"left({tags_off(f'(case when {named} <> {q(str())} then {named} when {start} <> {q(str())} then {classed} else {q(str())} end)')}, {most})"


def title(c: str) -> str:
    inner = f"regexp_extract({c}, '(?is)<title[^>]*>(.*?)</title>', 1)"
    return f"left({strip(unescape(inner))}, 500)"


def metas(c: str) -> str:
    """list of {k, v}: the last of equal keys, in their order."""
    tag = r"(?is)<meta\s[^>]*>"
    quoted = lambda n: rf"""regexp_extract(t, '(?is)\s{n}\s*=\s*["'']([^"'']*)["'']', 1)"""
    bare = lambda n: rf"""regexp_extract(t, '(?is)\s{n}\s*=\s*([^\s"''>]+)', 1)"""
    at = lambda n: f"coalesce(nullif({quoted(n)}, ''), {bare(n)})"
    pairs = f"list_filter(list_transform({found(c, tag)}, lambda t: {{'k': lower(coalesce(nullif({at('name')}, ''), {at('property')})), 'v': left({unescape(at('content'))}, 1000)}}), lambda p: p.k <> '' and p.v <> '')"
    return pairs


def scheme(u: str) -> str:
    return rf"lower(regexp_extract({u}, '^([a-zA-Z][a-zA-Z0-9+.\-]*):', 1))"


def netloc(u: str) -> str:
    return rf"regexp_extract({u}, '^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//([^/?#]*)', 1)"


def host(u: str) -> str:
    return f"split_part(lower(split_part({netloc(u)}, '@', -1)), ':', 1)"


def path(u: str) -> str:
    return rf"regexp_extract({u}, '^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)', 1)"


def query(u: str) -> str:
    return rf"regexp_extract({u}, '^[^?#]*\?([^#]*)', 1)"


def safe(u: str) -> str:
    return f"coalesce({scheme(u)} in ('http', 'https') and {host(u)} <> '' and not {among(host(u), C.SAFE_BLOCKED_HOSTS)} and not {prefixed(host(u), C.SAFE_BLOCKED_PREFIXES)}, false)"


def contact(u: str) -> str:
    return f"regexp_matches(lower({u}), {q(C.CONTACT_PAGE)})"


def maps(u: str) -> str:
    full = f"case when contains({u}, '://') then {u} else 'https://' || {u} end"
    return f"((contains(lower({netloc(full)}), 'google.') and contains(lower({path(full)}), '/maps')) or {among(f'lower({netloc(full)})', C.MAPS_HOSTS)})"


def bare(raw: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace(lower({strip(raw)}), '^https://', ''), '^http://', ''), '^www[.]', '')"


def cleaned_domain(raw: str) -> str:
    return f"regexp_extract({bare(raw)}, '^[^/?#]*')"


def domain_reason(raw: str) -> str:
    d = f"lower({strip(raw)})"
    return f"case when {raw} is null or {raw} = '' then 'Empty domain' when length({d}) > 253 then 'Domain too long' when {among(d, C.BLOCKED_DOMAINS)} then 'Blocked placeholder domain: ' || {d} when not regexp_matches({d}, {q(C.DOMAIN_SYNTAX)}) then 'Invalid domain format: ' || {d} end"


def normal_domain(raw: str) -> str:
    d = f"rtrim({cleaned_domain(raw)}, '.')"
    return f"case when ({domain_reason(d)}) is null then {d} end"


_WHERE = f"({path('u')} || case when {query('u')} <> '' then '?' || {query('u')} else '' end)"
URL_REASON = f"""case when url is null or url = '' then 'Empty or non-string URL' when length(u) > 2048 then 'URL too long' when contains(lower(u), '<script') then 'Blocked pattern detected: <script'
  when contains({_WHERE}, '../') then 'Blocked pattern detected: \\.\\./' when regexp_matches({_WHERE}, '//[^/]') then 'Blocked pattern detected: //[^/]'
  when {scheme("u")} not in ('http', 'https') then 'Disallowed scheme: ''' || {scheme("u")} || '''' when {host("u")} = '' then 'Missing hostname' when {among(host("u"), C.URL_BLOCKED_HOSTS)} then 'Blocked host: ' || {host("u")}
  when {prefixed(host("u"), C.URL_PRIVATE_PREFIXES)} then 'Private IP range blocked: ' || {host("u")} when not contains({host("u")}, '.') then 'Invalid hostname: ' || {host("u")} end"""

_FULL = "case when starts_with(url, 'http://') or starts_with(url, 'https://') then url else 'https://' || url end"


def issues(text: str) -> str:
    """page_id and a list of codes or of texts."""
    t = C.ISSUE_TEXT
    say = (lambda code, full=None: q(code)) if text == "codes" else (lambda code, full=None: full or q(t[code]))
    year = f"try_cast(regexp_extract(footer, {q(C.COPYRIGHT_YEAR)}, 1) as int)"
    ld = r"""(?is)<script[^>]*type\s*=\s*["']application/ld\+json["'][^>]*>(.*?)</script>"""
    return f"""(with p as (select *, {host("url")} as h, {section("html", "footer", 5000)} as footer, {metas("html")} as m from pages),
    c as (select h, bool_or({contact("url")}) as has_contact from p group by h)
    select page_id, list_filter([case when not starts_with(lower(url), 'https://') then {say("no_ssl")} end, case when {title("html")} = '' then {say("no_title")} end,
      case when len(list_filter(m, lambda e: e.k = 'description')) = 0 then {say("no_meta_description")} end, case when len(list_filter(m, lambda e: e.k = 'viewport')) = 0 then {say("no_viewport")} end,
      case when len(list_filter({found("html", ld, 1)}, lambda b: json_valid(b))) = 0 then {say("no_structured_data")} end,
      case when 2026 - {year} >= 2 then {say("outdated_copyright", f"{q(t['outdated_copyright'])} || {year} || ')'")} end, case when not has_contact then {say("no_contact_page")} end], lambda i: i is not null) as found
    from p join c using (h))"""


def finds(pages: str, url_column: bool = False) -> str:
    """page_id, pass_no, strategy_no, match_no, address, method, hint."""
    quoted = f"list_concat({mailto('html')}, {found(visible('html'), C.EMAIL_OR_QUOTED)})"
    parts = [(1, 1, "mailto", mailto("html")), (1, 2, "html_regex", quoted), (1, 3, "footer", found(section("html", "footer", 5000), C.EMAIL)), (1, 4, "header", found(section("html", "header", 2000), C.EMAIL)),
             (2, 6, "javascript", SCRIPTS), (2, 7, "html_comment", COMMENTS), (2, 8, "base64", BASE64), (2, 9, "unicode_obfuscation", OBFUSCATED), (2, 10, "cloudflare_decode", CLOUDFLARE)]
    all_ = " union all ".join(f"select page_id, domain, url, {p} as pass_no, {s} as strategy_no, {q(m)} as method, {C.METHOD_HINT[m]} as hint, {sql} as f from p" for p, s, m, sql in parts)
    return f"""(with p as (select page_id, domain, url, html from {pages}), u as ({all_}),
    e as (select * exclude (f), i - 1 as match_no, {clean("f[i]")} as address from u, range(1, 1000) r(i) where i <= len(f))
    select * from e where (pass_no = 1 and contains(address, '@')) or (pass_no = 2 and regexp_matches(address, '@[^@]*\\.[^@]*$')))"""


def mailto(c: str) -> str:
    return f"list_filter(list_transform({found(c, C.MAILTO, 1)}, lambda x: lower(trim(split_part({unescape('x')}, '?', 1)))), lambda x: contains(x, '@'))"


SCRIPTS = each(found("html", C.SCRIPT, 1), outside("x"))
COMMENTS = each(found("html", C.COMMENT, 1), found("x", C.EMAIL))
BASE64 = each(f"list_filter(list_transform({found('html', C.BASE64, 1)}, lambda b: case when length(b) % 4 = 0 then try(decode(from_base64(b))) end), lambda b: b is not null)", outside("x"))
OBFUSCATED = each(f"list_transform({found('html', C.OBFUSCATED)}, lambda o: regexp_replace(o, {q(C.OBFUSCATED)}, '\\1@\\2.\\3'))", found("x", C.EMAIL))
_BYTE = "('0x' || substr(x, {0}, 2))::int"
_DECODED = f"list_transform(range(1, length(x) // 2), lambda i: chr(xor({_BYTE.format('i * 2 + 1')}, {_BYTE.format('1')})))"
CLOUDFLARE = f"""list_filter(list_transform(list_filter(list_concat({found("html", C.CLOUDFLARE, 1)}, {found("html", C.CLOUDFLARE_LINK, 1)}), lambda x: length(x) % 2 = 0 and length(x) >= 4),
    lambda x: lower(array_to_string({_DECODED}, ''))), lambda x: contains(x, '@') and contains(split_part(x, '@', -1), '.'))"""
_HEADERS = D.values(D.HEADERS, "page_id, headers")


def technologies(html: str, headers: str | None = None) -> str:
    rules = [f"case when regexp_matches({html}, {q('(?i)' + rx)}) then {q(f'{n}/{c}/html')} end" for n, c, rx in C.TECHNOLOGIES]
    if headers:
        value = lambda h: f"list_filter(map_entries({headers}), lambda e: lower(e.key) = {q(h)})"
        rules += [f"case when len({value(h)}) > 0 and contains(lower({value(h)}[1].value), {q(v)}) then {q(f'{n}/{c}/header')} end" for n, c, h, v in C.HEADER_TECHNOLOGIES]
    return f"list_filter([{', '.join(rules)}], lambda x: x is not null)"


_SOCIAL = " union all ".join(f"select page_id, domain, {q(p)} as platform, split_part(rtrim(regexp_extract(html, {q(rx)}), '/'), '?', 1) as link from {PAGES}" for p, rx in C.SOCIAL.items())
_PHONE = r"(?:\+?1[\s.\-]?)?(?:\(([2-9]\d{2})\)|([2-9]\d{2}))[\s.\-]?([2-9]\d{2})[\s.\-]?(\d{4})"
PHONES = f"""list_transform({found("text", rf"(?:^|[^0-9.])({_PHONE})(?:$|[^0-9.]|[.](?:$|[^0-9]))", 1)}, lambda x: '+1' || right(regexp_replace(x, '[^0-9]', '', 'g'), 10))"""
_CSV = D.values([(n, w, i + 2) for i, (n, w) in enumerate(D.COMPANY_CSV)], "name, website, source_row")
_RAW = strip("website")
IMPORT = f"""(with r as (select source_row, coalesce({_RAW}, '') as raw, nullif(left({strip("name")}, 500), '') as name from {_CSV}),
    d as (select *, case when raw = '' then null when {maps("raw")} then 'maps-' || left(sha1(raw), 16) || '.pending' else {normal_domain("raw")} end as domain, raw <> '' and {maps("raw")} as is_map from r)
    select source_row, raw, name, domain, case when is_map then raw else 'https://' || domain end as website,
      case when raw = '' then 'empty' when domain is null then 'invalid' when source_row > min(source_row) over (partition by domain) then 'duplicate' else 'queued' end as outcome from d)"""
_STORED = D.values(D.STORED, "domain")
_LOC = r"<loc>\s*(.*?)\s*</loc>"
_SITEMAPS = f"""(select *, case when regexp_matches(xml, '</urlset>\\s*$') then list_filter(list_transform({found("xml", _LOC, 1)}, lambda u: replace(u, '&amp;', '&')), lambda u: {safe("u")})[:50] else [] end as urls from {D.values(D.SITEMAPS, "base_url, priority, xml")})"""


def ordered_distinct(c: str) -> str:
    return f"list_filter({c}, lambda v, i: list_position({c}, v) = i)"


def contact_first(c: str) -> str:
    good = ordered_distinct(f"list_filter({c}, lambda u: {safe('u')})")
    return f"list_concat(list_filter({good}, lambda u: {contact('u')}), list_filter({good}, lambda u: not {contact('u')}))[:50]"


def oracle_sql() -> dict[str, str]:
    signals = ["via_mailto", "on_contact_page", "mx_valid", "company_domain_match", "is_disposable", "is_role_based"]
    weights = " + ".join(f"case when {s} then {C.SIGNAL_WEIGHTS[s]} else 0 end" for s in signals)
    facts = f"""(select a.address, m.host is not null as mx_ok, d.resolves, s.smtp_valid as smtp_known from {D.values(D.ADDRESSES, "address")} a
      left join {D.values(D.MX, "email_domain, host")} m on m.email_domain = split_part(lower(trim(a.address)), '@', -1)
      left join {D.values(D.DNS, "email_domain, resolves")} d on d.email_domain = split_part(lower(trim(a.address)), '@', -1)
      left join {D.values(D.SMTP, "address, smtp_valid")} s on s.address = a.address)"""
    addresses = f"(select address, lower({strip('address')}) as a from {D.values(D.ADDRESSES, 'address')})"
    trail = rf"regexp_replace({path('f')}, '/+$', '')"
    pages_domain = f"(select page_id, {host('url')} as domain, url, html from pages)"
    first_on_page = f"(select * from (select *, row_number() over (partition by page_id, pass_no, address order by strategy_no, match_no) as rn from {finds(PAGES)}) where rn = 1)"
    company = f"(select * from (select *, row_number() over (partition by domain, address order by page_id, pass_no, strategy_no, match_no) as rn from {finds(PAGES)}) where rn = 1)"
    company_score = f"""least(100, greatest(0, {method_base("method")} + 15 + case when method = 'mailto' then 25 else 0 end + case when {contact("url")} then 15 else 0 end
      + case when {DOMAIN.format("address")} = regexp_replace(domain, '^www[.]', '') then 10 else 0 end - case when is_disposable then 50 else 0 end - case when not is_valid_syntax then 60 else 0 end
      - case when is_role_based then 15 else 0 end - case when method = 'html_comment' then 5 else 0 end + case when mx_valid then 0 else -15 - 20 end))"""
    one = lambda name, sql: {name: f"select page_id, {listed(sql)} as found from {PAGES}"}
    out = {
        "email_scan": f"""select 'documents' as origin, doc_id as id, match_no::int as match_no, address from {DOC_EMAILS} union all
          select 'pages', page_id, (i - 1)::int, {clean("f[i]")} from (select page_id, {found("html", C.EMAIL)} as f from pages), range(1, 10000) r(i) where i <= len(f)""",
        "email_scan_quoted": f"select page_id, {listed(found('html', C.EMAIL_OR_QUOTED))} as found from {PAGES}",
        "email_distinct": f"select * from (select doc_id, {listed(f'list_sort(list_distinct({found("text", C.EMAIL_OR_QUOTED)}))')} as addresses from documents) where addresses <> ''",
        "email_hash": f"select distinct address, sha256(address) as address_hash from {DOC_EMAILS}",
        "content_hash": f"select doc_id, sha256(lower({strip('text')})) as content_hash from documents",
        "email_validate": f"select * from {validated(DOC_EMAILS, 'doc_id, match_no::int as match_no, address')}",
        "email_validate_facts": f"select * from {validated(facts, 'address', mx=True)}",
        "email_status_counts": f"select validation_status, count(*) as n from {validated(DOC_EMAILS, 'address')} group by 1",
        "email_parts": f"select address, {LOCAL.format('a')} as local, {DOMAIN.format('a')} as domain, {domain_ok(DOMAIN.format('a'))} as domain_ok from {addresses} where contains(address, '@')",
        "disposable_semi": f"select address from {addresses} where {among(DOMAIN.format('a'), C.DISPOSABLE_DOMAINS + C.PLACEHOLDER_DOMAINS)}",
        "role_semi": f"select address from {addresses} where {among(LOCAL.format('a'), C.ROLE_PREFIXES)}",
        "score_signals": f"""select *, case when confidence >= 95 then 'Verified' when confidence >= 85 then 'High' when confidence >= 70 then 'Risky' else 'Invalid' end as tier from
          (select *, greatest(0, least(100, {method_base("method")} + {weights} - case when method = 'html_comment' then 5 when method = 'ocr' then 10 else 0 end))::int as confidence from {D.values(D.SIGNALS, "method, " + ", ".join(signals))})""",
        "email_first_occurrence": f"select source, address, doc_id, match_no::int as match_no, sha256(address) as address_hash from {FIRST}",
        "email_pipeline": f"""select * from (select source, address, sha256(address) as address_hash, doc_id,
          least(100, greatest(0, 60 + 15 - case when is_disposable then 50 else 0 end - case when is_role_based then 15 else 0 end - case when not is_valid_syntax then 60 else 0 end + case when mx_valid then 0 else -35 end))::int as confidence,
          validation_status, is_role_based from {validated(FIRST, "source, address, doc_id")}) where confidence >= {C.MIN_CONFIDENCE}""",
        "page_finds": f"select page_id, pass_no::int as pass_no, strategy_no::int as strategy_no, match_no::int as match_no, address, method, hint::int as hint from {finds(pages_domain)}",
        "fixture_finds": f"select page_id, pass_no::int as pass_no, address, method, hint::int as hint from {first_on_page}",
        "company_emails": f"""select domain, address, method, confidence, validation_status, page_id from (select *, ({company_score})::int as confidence from {validated(company, "domain, address, method, url, page_id")}) where confidence >= {C.MIN_CONFIDENCE}""",
        **one("script_emails", SCRIPTS), **one("comment_emails", COMMENTS), **one("base64_emails", BASE64), **one("obfuscated_emails", OBFUSCATED), **one("cloudflare_emails", CLOUDFLARE), **one("mailto_emails", mailto("html")),
        "page_comment_emails": f"select page_id, len({found('html', C.COMMENT, 1)})::int as comments, {listed(COMMENTS)} as found from pages",
        "emails_per_page": f"select page_id, coalesce(n, 0) as emails_found from {PAGES} left join (select page_id, count(*) as n from {first_on_page} group by 1) using (page_id)",
        "url_validate": f"select url, {URL_REASON} as reason, case when ({URL_REASON}) is null then split_part(u, '#', 1) end as clean from (select url, {strip('url')} as u from {D.values(D.URLS, 'url')})",
        "url_safe": f"select distinct url, {safe('url')} as safe, {contact('url')} as contact, {maps('url')} as maps from (select url from {D.values(D.URLS, 'url')} union all select url from pages)",
        "url_normalize": f"""select page_id, {scheme("f")} || '://' || lower({netloc("f")}) || case when {trail} = '' then '/' else {trail} end || case when {query("f")} <> '' then '?' || {query("f")} else '' end as normal,
          {scheme("url")} || '://' || {netloc("url")} as base, {host("url")} as host from (select page_id, url, {_FULL} as f from pages)""",
        "domain_normalize": f"""select raw, {normal_domain("raw")} as domain, {cleaned_domain("raw")} as cleaned, rtrim({bare("raw")}, '/') as form, {domain_reason("raw")} as reason,
          'maps-' || left(sha1(raw), 16) || '.pending' as placeholder, regexp_matches({cleaned_domain("raw")}, {q(C.MAPS_PENDING)}) as pending from {D.values(D.DOMAINS, "raw")}""",
        "registered_domains": f"select array_to_string(string_split({host('url')}, '.')[-2:], '.') as site, count(*) as pages from pages group by 1",
        "page_title": f"select page_id, {title('html')} as title from pages",
        "page_meta": f"""select page_id, {listed("list_sort(list_transform(list_filter(m, lambda e, i: len(list_filter(m[i + 1:], lambda o: o.k = e.k)) = 0), lambda e: e.k || '=' || e.v))")} as meta,
          left(coalesce(list_filter(m, lambda e: e.k = 'description')[-1].v, ''), 500) as description from (select page_id, {metas("html")} as m from {PAGES})""",
        "page_footer": f"select page_id, {section('html', 'footer', 5000)} as footer, {section('html', 'header', 2000)} as header from pages",
        "page_text_len": f"select page_id, length(t)::int as chars, md5(t) as digest from (select page_id, left({visible('html')}, 50000) as t from pages)",
        "page_issues": f"select page_id, {listed('found')} as codes from {issues('codes')}",
        "issue_summary": f"""select page_id, case when len(found) = 0 then {q(C.NO_ISSUES)} else array_to_string(found[:coalesce(list_position(list_transform(range(1, len(found) + 1), lambda i: length(array_to_string(found[:i], '; ')) > 100), true) - 1, len(found))], '; ') end as summary from {issues("texts")}""",
        "issue_counts": f"select unnest(found) as code, count(*) as n from {issues('codes')} group by 1",
        "tech_detect": f"""select page_id, {listed("list_filter(t, lambda x, i: len(list_filter(t[:i - 1], lambda y: split_part(y, '/', 1) = split_part(x, '/', 1))) = 0)")} as technologies from
          (select page_id, {technologies("html", "headers")} as t from {PAGES} left join {_HEADERS} using (page_id))""",
        "tech_pages": f"select h as host, split_part(t, '/', 1) as name, min(page_id) as first_page from (select page_id, {host('url')} as h, unnest({technologies('html')}) as t from pages) group by all",
        "social_links": f"select page_id, platform, link from ({_SOCIAL}) where link <> ''",
        "social_merged": f"select domain, platform, arg_min(link, page_id) as link from ({_SOCIAL}) where link <> '' group by 1, 2",
        "phone_scan": f"select * from (select doc_id, {listed(ordered_distinct(PHONES))} as phones from documents) where phones <> ''",
        "phone_union": f"""select source, string_agg(phone, '|' order by a.d, a.i, phone) as phones from (select source, phone, min({{'d': doc_id, 'i': i}}) as a from
          (select source, doc_id, i, p[i] as phone from (select source, doc_id, {PHONES} as p from documents), range(1, 1000) r(i) where i <= len(p)) group by source, phone) group by source""",
        "business_summary": f"""select id, coalesce(nullif(left(array_to_string(list_filter([nullif(trim(description), ''), case when len(s) > 0 then 'Services: ' || array_to_string(s[:6], ', ') || '.' end,
          'Industry: ' || coalesce(nullif(industry, ''), nullif(category, '')) || '.'], lambda x: x is not null), ' '), 800), ''), 'No business description found on site.') as summary from
          (select *, list_filter(string_split(services, '|'), lambda x: x <> '') as s from {D.values(D.SUMMARIES, "id, description, services, industry, category")})""",
        "home_pages": f"select domain, min(page_id) as page_id from {PAGES} where url = {scheme('url')} || '://' || {netloc('url')} || '/' group by 1",
        "escalation": "select page_id, true as escalate from pages where length(html) < 500",
        "pages_per_host": f"select {host('url')} as host, count(*) as pages, min(page_id) as first_page, sum(length(html))::bigint as chars from pages group by 1",
        "sitemap_urls": f"select base_url, priority, {listed('urls')} as urls from {_SITEMAPS}",
        "sitemap_best": f"select base_url, {listed(contact_first('p'))} as pages from (select base_url, arg_min(urls, priority) as p from {_SITEMAPS} where len(urls) > 0 group by 1)",
        "robots_sitemap": rf"select base_url, nullif(regexp_extract(txt, '(?im)^sitemap:[ \t]*(http\S*)', 1), '') as sitemap from {D.values(D.ROBOTS, 'base_url, txt')}",
        "crawl_plan": f"""select base, {listed(ordered_distinct("plan") + "[:20]")} as plan from (select base, list_concat([base], {contact_first("urls")}, list_transform([{", ".join(map(q, C.KNOWN_PATHS))}], lambda k: rtrim(base, '/') || k)) as plan from
          (select {scheme("url")} || '://' || {netloc("url")} as base, list_sort(list_distinct(list(url))) as urls from pages group by 1))""",
        "import_clean": f"select * from {IMPORT}",
        "import_summary": f"""select count(*) as total_rows, count_if(outcome = 'queued')::bigint as queued_jobs, count_if(outcome <> 'queued')::bigint as skipped_rows,
          coalesce(string_agg('Row ' || source_row || ': invalid domain ''' || raw || '''', '|' order by source_row) filter (outcome = 'invalid'), '') as errors from {IMPORT}""",
        "import_anti": f"select source_row, domain, website from {IMPORT} where outcome = 'queued' and domain not in (select domain from {_STORED})",
        "import_customers": """select c_custkey, c_custkey % 1000 as "group", c_nationkey from (select *, row_number() over (partition by c_custkey % 1000 order by c_custkey) as rn from customer)
          where rn = 1 and c_custkey % 1000 not in (select c_custkey % 1000 from customer where c_custkey % 2 = 0 and c_nationkey < 12)""",
        "maps_resolve": f"""with p as (select id, {normal_domain("resolved")} as nd from {D.values(D.MAPS, "id, url, resolved")})
          select id, nd as new_domain, case when nd is null then 'no_website' when nd in (select domain from {_STORED}) or id > min(id) over (partition by nd) then 'duplicate_listing' else 'resolved' end as outcome from p""",
        "status_counts": "select o_orderstatus as status, count(*) as n from orders group by 1",
        "status_page": "select o_orderkey, o_custkey, o_orderdate from orders where o_orderstatus = 'F' order by o_orderdate, o_orderkey limit 100 offset 200",
        "topk_per_company": "select * from (select o_custkey, o_orderkey, o_totalprice, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey)::int as rank from orders) where rank <= 3",
        "topk_global": "select o_orderkey, o_totalprice from orders where o_totalprice >= 1000 order by o_totalprice desc, o_orderkey limit 500",
        "count_per_company": "select o_custkey, count(*) as n from orders where o_orderpriority <> '5-LOW' group by 1",
        "stats": "select o_orderstatus, count(*) as n, (select count(*) from orders where o_totalprice > 100000) as valid from orders group by 1",
        "export_nested": """select c_custkey, c_name, count(o_orderkey)::int as n, coalesce(string_agg(o_orderkey || ':' || o_orderstatus, '|' order by o_totalprice desc, o_orderkey), '') as orders
          from customer left join (select * from orders where o_orderstatus <> 'P') on o_custkey = c_custkey group by 1, 2""",
        "export_totals_query": "select (select count(*) from customer) as companies, count(*)::bigint as emails, count(distinct o_custkey) as leads from orders join customer on o_custkey = c_custkey",
        "status_split": "select case when c_custkey in (select o_custkey from orders) then 'leads' else 'no_email' end as kind, count(*) as companies from customer group by 1",
        "engines_used": "select l_orderkey, string_agg(f, '|' order by i, f) as flags from (select l_orderkey, l_returnflag as f, min(l_linenumber) as i from lineitem group by 1, 2) group by 1",
        "keyset_page": "select epoch(o_orderdate)::bigint as at, o_orderkey, o_custkey from orders where o_orderdate > timestamp '1996-07-01' or (o_orderdate = timestamp '1996-07-01' and o_orderkey > 100) order by o_orderdate, o_orderkey limit 100",
        "customer_places": "select c_mktsegment, c_name, c_custkey, row_number() over (order by c_mktsegment, c_name, c_custkey) as place from customer",
        "batch_ids": "select o_orderkey, ceil(row_number() over (order by o_orderkey) / 100.0)::bigint as batch_id from orders",
        "keyed_update": "select o_orderkey, case when o_orderkey % 7 = 0 then 'completed' else o_orderstatus end as o_orderstatus, case when o_orderkey % 14 = 0 then '1-URGENT' else o_orderpriority end as o_orderpriority from orders",
        "increment_retry": "select o_orderkey, (o_orderkey % 5 + case when o_orderkey % 3 = 0 then 1 else 0 end)::int as retry_count from orders",
        "retry_split": "select o_orderkey, (case when o_orderkey % 5 < 3 then o_orderkey % 5 + 1 else o_orderkey % 5 end)::int as retry_count, case when o_orderkey % 5 >= 3 then 'crawl' end as dead_letter_source from orders where o_orderstatus = 'P'",
        "cascade_delete": "select l_orderkey, l_linenumber, l_quantity from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderstatus = 'F')",
        "job_emails": "select o_orderkey, c_custkey, c_name from (select o_orderkey, unnest([o_custkey, o_custkey + 100000]) as k from orders where o_orderkey % 50 = 0) join customer on c_custkey = k",
        "job_round_trip": "select o_orderkey::varchar as job_id, o_custkey::varchar as company_id, o_orderstatus as domain, 5::int as priority, 0::int as retry_count from orders",
        "truthy_update": "select c_custkey, case when c_custkey % 3 = 1 then 'New ' || c_custkey else c_name end as name from customer",
        "queue_rates": "select event_type, count(*) as n, round(count(*) / greatest((epoch(max(ts))::bigint - epoch(min(ts))::bigint) / 60.0, 1.0), 2) as per_minute from events group by 1",
        "backoff": "select r_regionkey, least(2.0::double ** (r_regionkey * 2), 30.0::double) as seconds from region",
        "token_bucket": f"""select event_id, event_type, round(greatest(0.0, -(4.0 + u - max(u) over w) / 5.0), 6) as wait from
          (select event_id, event_type, s, 5.0::double * s - row_number() over (partition by event_type order by s, event_id) as u from (select *, floor(epoch(ts))::bigint as s from events))
          window w as (partition by event_type order by s, event_id rows unbounded preceding)""",
        "gated_events": """with recursive m as (select *, row_number() over (partition by key order by at_ms, kind = 'job', job_id) as rn from
            (select user_id::varchar as key, (event_id % 3)::varchar as job_id, case event_type when 'purchase' then 'done' when 'error' then 'failed' else 'job' end as kind, epoch_us(ts) // 1000 as at_ms from events)),
          s as (select distinct key, 0::bigint as rn, null::bigint as done, null::bigint as lock_ms, null::varchar as held, null::varchar as outcome, null::varchar as job_id, null::bigint as at_ms from m
            union all select key, rn, case when kind = 'done' then greatest(coalesce(done, at_ms), at_ms) else done end, case when outcome = 'claimed' then at_ms + 21600000 else lock_ms end,
              case when outcome = 'claimed' then job_id when kind <> 'job' and h = job_id then null else h end, outcome, job_id, at_ms
            from (select *, case when kind = 'job' then case when done is not null and at_ms - done < 86400000 then 'recent' when h is not null then 'locked' else 'claimed' end end as outcome
              from (select m.*, s.done, s.lock_ms, case when s.held is not null and s.lock_ms <= m.at_ms then null else s.held end as h from s join m on m.key = s.key and m.rn = s.rn + 1)))
          select key, job_id, at_ms, outcome, count(*) as n from s where outcome is not null group by all""",
        "suffix_domains": f"""with h as (select host, count(*) as n from (select host from {D.values(D.SUFFIX_HOSTS, "host")} union all select {host("url")} from pages) group by 1),
          r as (select * from {D.values(D.SUFFIX_RULES, "rule")}),
          l as (select host, string_split(rtrim(lower(host), '.'), '.') as parts from h where host <> '' and not regexp_matches(host, '^[0-9.]*$') and not contains(host, ':')),
          t as (select host, parts, k, array_to_string(parts[-k:], '.') as tail, array_to_string(parts[len(parts) - k + 2:], '.') as rest from l, range(1, 12) x(k) where k <= len(parts)),
          m as (select host, parts, starts_with(rule, '!') as exempt, k - starts_with(rule, '!')::int as taken from t join r on rule = tail or rule = '!' || tail or (k > 1 and rule = '*.' || rest)),
          b as (select host, any_value(parts) as parts, max({{'e': exempt, 'k': taken}}).k as k from m group by host)
          select h.host, array_to_string(parts[len(parts) - k + 1:], '.') as suffix, case when len(parts) > k then array_to_string(parts[len(parts) - k:], '.') end as registered, n from h left join b using (host)""",
        "recent_dedup": """with recursive e as (select event_id, user_id, floor(epoch(ts))::bigint as s from events),
          k as (select user_id, min({'s': s, 'event_id': event_id}) as f from e group by user_id
            union all select k.user_id, (select min({'s': e.s, 'event_id': e.event_id}) from e where e.user_id = k.user_id and e.s >= k.f.s + 86400) as f from k where k.f is not null)
          select f.event_id as event_id, user_id, f.s as s from k where f is not null""",
    }
    out |= rich_sql()
    # every link of the pages table is a path from the root or whole, and none holds dot segments
    refs = lambda tag, at: f"""list_transform({found("html", rf'(?is)<{tag}\s[^>]*?{at}\s*=\s*"([^"]*)"', 1)}, lambda r: {unescape("trim(r)")})"""
    whole_url = f"case when regexp_matches(r, '^[a-zA-Z][a-zA-Z0-9+.-]*:') then r else {scheme('url')} || '://' || {netloc('url')} || r end"
    safe_of = lambda rs: f"list_filter(list_transform({rs}, lambda r: {whole_url}), lambda u: {safe('u')})"
    out["parsed_pages"] = f"""select page_id, len(links)::int as links, len(pdfs)::int as pdfs, len(images)::int as images, md5({listed("links")}) as digest from (select page_id,
      {safe_of("list_filter(hrefs, lambda r: not ends_with(lower(r), '.pdf'))")} as links, {safe_of("list_filter(hrefs, lambda r: ends_with(lower(r), '.pdf'))")} as pdfs, {safe_of("srcs")} as images
      from (select page_id, url, list_filter({refs("a", "href")}, lambda r: not starts_with(lower(r), 'mailto:')) as hrefs, list_filter({refs("img", "src")}, lambda r: r <> '') as srcs from pages))"""
    # the same over whole tables: fixture pages beside the table of pages, or the table alone
    whole = f"select page_id{{}}, {host('url')} as domain, url{{}}, html from pages"
    beside = f"(select * from {PAGES} union all {whole.format(' + 1000000', '')})"
    rich = f"(select * from {RICH} union all {whole.format(' + 1000000', ', true')})"
    names = "script_emails comment_emails base64_emails obfuscated_emails cloudflare_emails mailto_emails fixture_finds tech_detect social_links social_merged home_pages".split()
    out |= {f"{n}_all": out[n].replace(PAGES, beside) for n in names}
    out |= {f"{n}_all": out[n].replace(RICH, rich) for n in ("rich_finds", "schema_emails", "rich_sections", "company_metadata", "company_phones")}
    out |= {f"{n}_all": out[n].replace(PAGES, f"({whole.format('', '')})") for n in ("email_scan_quoted", "page_meta", "emails_per_page", "company_emails")}
    out["job_emails_all"] = out["job_emails"].replace(" where o_orderkey % 50 = 0", "")
    return out


RICH = D.values(D.RICH_PAGES, "page_id, domain, url, success, html")
_LD = r"""(?is)<script[^>]*type\s*=\s*["']application/ld\+json["'][^>]*>(.*?)</script>"""
_LD_BLOCKS = f"list_filter({found('html', _LD, 1)}, lambda b: json_valid(b))"


def og(relation: str) -> str:
    """page_id, name, content: the last of equal names counts."""
    return f"""(select page_id, e.k[4:] as name, left(e.v, 500) as content from (select page_id, unnest(list_filter(m, lambda e, i: starts_with(e.k, 'og:') and len(list_filter(m[i + 1:], lambda o: o.k = e.k)) = 0)) as e
      from (select page_id, {metas("html")} as m from {relation})))"""


def schema_addresses() -> str:
    """page_id, address: of the leaves whose key, or whose list's key, is one of mail; what stands in an object under such a key is not read."""
    mail = "(email|contactemail|contactpoint)"
    return f"""(select distinct page_id, unnest({found("leaf", C.EMAIL)}) as address from (select page_id, t.fullkey as path, t.value ->> '$' as leaf
      from (select page_id, unnest({_LD_BLOCKS}) as block from {RICH}) b, json_tree(b.block::json) t where t.type = 'VARCHAR')
      where regexp_matches(path, '(?i)[.]"?{mail}"?([[][0-9]+[]])?$') and not regexp_matches(path, '(?i)[.]"?{mail}"?[.]'))"""


def rich_sql() -> dict[str, str]:
    finds_of = finds(f"(select page_id, domain, url, html from {RICH})")
    all_finds = f"""(select page_id, pass_no, strategy_no, match_no, address, method, hint from {finds_of} union all
      select page_id, 1, 5, 0, {clean("address")}, 'schema_ld', {C.METHOD_HINT["schema_ld"]} from {schema_addresses()})"""
    ld = "(select page_id, domain, [x for x in blocks if (x ->> '$.\"@type\"') is not null][1] as x from (select page_id, domain, {b} as blocks from {r}))".format(b=_LD_BLOCKS.replace("lambda b: json_valid(b))", "lambda b: json_valid(b))::json[]"), r=RICH)
    usable = "success and coalesce(html, '') <> ''"
    title_ = f"nullif({title('html')}, '')"
    described = f"nullif(left(coalesce(list_filter({metas('html')}, lambda e: e.k = 'description')[-1].v, ''), 500), '')"
    og_of = lambda n: f"(select nullif(content, '') from {og(RICH)} o where o.page_id = p.page_id and name = '{n}')"
    first = f"""(select p.domain, p.page_id, coalesce(nullif(l.x ->> '$.name', ''), {og_of("site_name")}, {title_}) as name, coalesce(nullif(l.x ->> '$.description', ''), {og_of("description")}, {described}) as description,
      coalesce(l.x ->> '$.telephone', '') as phones from {RICH} p left join {ld} l on l.page_id = p.page_id where {usable} and p.page_id = (select min(page_id) from {RICH} q where q.domain = p.domain and q.success and q.html <> ''))"""
    footer = section("html", "footer", 5000)
    pages_both = f"(select page_id, url, html from {PAGES} union all select page_id, url, html from pages)"
    seven, five = "page_id % 3 <> 0", "page_id % 5 <> 0"
    both = f"(select page_id, html from {RICH} union all select page_id, html from pages)"
    link = r"""(?is)<link\s[^>]*>"""
    t = C.ISSUE_TEXT
    exported = lambda where, more: f"""select c_custkey::varchar as id, c_name as name, coalesce(string_agg(conf || ':' || o_orderkey || ':' || o_orderstatus, '|' order by conf desc, o_orderkey::varchar), '') as emails
      from customer left join (select *, o_orderkey % 101 as conf from orders where o_orderkey % 4 <> 0 and o_orderkey % 101 >= {where}) on o_custkey = c_custkey {more} group by 1, 2"""  # noqa: E731
    return {
        "rich_finds": f"select page_id, pass_no::int as pass_no, address, method, hint::int as hint from (select *, row_number() over (partition by page_id, pass_no, address order by strategy_no, match_no) as rn from {all_finds}) where rn = 1",
        "schema_emails": f"select p.page_id, coalesce(string_agg(address, '|' order by address), '') as found from {RICH} p left join {schema_addresses()} a using (page_id) group by 1",
        "rich_sections": f"""select page_id, {title("html")} as title, {footer} as footer, {section("html", "header", 2000)} as header, regexp_extract({footer}, {q(C.COPYRIGHT_YEAR)}, 1) as year,
          coalesce({described}, '') as description from {RICH}""",
        "open_graph": f"select page_id, name, content from {og(both)}",
        "company_metadata": f"select domain, name, description, phones from {first}",
        "company_phones": f"""select f.domain, array_to_string(list_distinct_in_order, '|') as phones from (select f.domain, list_filter(list_concat(case when f.phones <> '' then [f.phones] else []::varchar[] end, coalesce(x.found, []::varchar[])), lambda v: true) as list_distinct_in_order
          from {first} f left join (select domain, list(phone order by page_id, i) as found from (select domain, phone, min(page_id) as page_id, min(i) as i from (select domain, page_id, i, ph[i] as phone from
            (select domain, page_id, {PHONES.replace("text", "body")} as ph from (select *, {visible("html")} as body from {RICH} where {usable})), range(1, 100) r(i) where i <= len(ph)) group by 1, 2) group by 1) x on x.domain = f.domain) f""",
        "site_technologies": f"""select h as host, split_part(x, '/', 1) as name, page_id, split_part(x, '/', 2) as category, split_part(x, '/', 3) as detection from (select *, row_number() over (partition by h, split_part(x, '/', 1) order by page_id, i) as rn
          from (select h, page_id, i, t[i] as x from (select page_id, {host("url")} as h, {technologies("html")} as t from {pages_both}), range(1, 100) r(i) where i <= len(t))) where rn = 1""",
        "page_profiles": "select h as host, platform, arg_min(link, page_id) as link from (" + " union all ".join(
            f"select page_id, {host('url')} as h, {q(p)} as platform, split_part(rtrim(regexp_extract(html, {q(rx)}), '/'), '?', 1) as link from {pages_both}" for p, rx in C.SOCIAL.items()) + ") where link <> '' group by 1, 2",
        "escalated_pages": "select page_id, true as escalate from pages where page_id % 7 = 0 or (page_id % 5 <> 0 and length(case when page_id % 9 = 0 then left(html, 300) else html end) < 500)",
        "usable_pages": f"select page_id, length(html)::int as chars from (select page_id, {seven} as success, case when {five} then html end as html from pages union all select page_id, success, html from {RICH}) where {usable}",
        "feed_heads": f"""select id, case when contains(xml, '<feed>') then regexp_extract(xml, '<title>(.*?)</title>', 1) when contains(xml, '<channel>') then {unescape("regexp_extract(xml, '<title>(.*?)</title>', 1)")} end as title,
          case when contains(xml, '<channel>') then regexp_extract(xml, 'CDATA.(.*?)..>', 1) end as description, case when contains(xml, '<channel>') then regexp_extract(xml, '<link>(.*?)</link>', 1) end as link from {D.values(D.FEEDS, "id, xml")}""",
        "feed_links": f"""select page_id, regexp_extract(l, '(?is)href\\s*=\\s*["'']([^"'']*)["'']', 1) as feed from (select page_id, list_filter({found("html", link)}, lambda t: regexp_matches(t, '(?i)rel\\s*=\\s*["''][^"'']*alternate')
          and regexp_matches(t, '(?i)type\\s*=\\s*["''][^"'']*(rss|atom)'))[1] as l from {both}) where l is not null""",
        "crawled_issues": f"""select page_id, code, text from (select page_id, unnest(case when page_id % 11 = 0 then [{{'code': 'unreachable', 'text': {q(t["unreachable"])}}}] else list_filter([
          case when page_id % 7 = 0 then {{'code': 'bad_status', 'text': {q(t["bad_status"])} || '503'}} end, case when page_id % 40 * 260 > {C.SLOW_MS} then {{'code': 'slow_load', 'text': {q(t["slow_load"])} || printf('%.1f', page_id % 40 * 0.26) || 's)'}} end,
          case when 2026 - y >= 2 then {{'code': 'outdated_copyright', 'text': {q(t["outdated_copyright"])} || y || ')'}} end], lambda i: i is not null) end, recursive := true) from (select page_id, try_cast(regexp_extract({footer}, {q(C.COPYRIGHT_YEAR)}, 1) as int) as y from pages))""",
        "export_filtered": exported(60, ""),
        "export_one": exported(0, "where c_custkey = 7"),
        "insert_two_keys": """select l_suppkey, l_partkey, l_orderkey, l_linenumber from (select *, row_number() over (partition by l_suppkey, l_partkey order by l_orderkey, l_linenumber) as rn from lineitem) n
          where rn = 1 and not exists (select 1 from lineitem s where s.l_orderkey % 3 = 0 and s.l_suppkey = n.l_suppkey and s.l_partkey = n.l_partkey)""",
        "engines_of_run": "select string_agg(distinct l_returnflag, '|' order by l_returnflag) as engines from lineitem",
        "company_lookup": "select c_custkey, c_name from customer where c_custkey = 7",
        "iso_times": "select event_id, strftime(ts::timestamp, '%Y-%m-%dT%H:%M:%S') as iso, strftime(ts::timestamp, '%Y%m%d_%H%M%S') as stamp from events",
        "claimed_jobs": "select o_custkey as domain, o_orderkey, case when row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) = 1 then 'claimed' else 'queued' end as outcome from orders",
        "not_recent_jobs": """select o_custkey as domain, o_orderkey from orders left join (select o_custkey, max(o_orderdate::date) as d from orders where o_orderstatus = 'F' group by 1) l using (o_custkey)
          where o_orderstatus <> 'F' and (d is null or o_orderdate::date - d >= 400)""",
        "run_progress": """select count(*) as jobs, count_if(o_orderstatus = 'O')::bigint as queued, 0::bigint as crawling, count_if(o_orderstatus = 'F')::bigint as done, count_if(o_orderstatus = 'P')::bigint as failed,
          round(count_if(o_orderstatus in ('F', 'P')) / count(*), 4) as share_over from orders""",
    }
