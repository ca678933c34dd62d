"""Types of text by cues in its head: ordered rules, the first that holds decides.

The rules read columns that ``context_sql`` derives from a text: ``h`` (its first 4096 characters after leading blanks),
``hl`` (in lower case), ``l1`` to ``l4`` (its first lines), ``decl`` (a declared extension, or an empty string) and cues.
"""

from __future__ import annotations

from dataclasses import dataclass

from . import logs
from .dialect import Dialect

HEAD = 4096


def context_sql(d: Dialect, text: str, declared: str) -> list[dict[str, str]]:
    """Columns to add, step by step, before the rules."""
    blank = "concat(' ', chr(9), chr(10), chr(13), chr(65279))"
    trimmed = f"ltrim({text}, {blank})" if d.duck else f"trim(leading {blank} from {text})"
    return [{"h": f"left({trimmed}, {HEAD})", "decl": declared}, {"hl": "lower(h)", **{f"l{i}": f"split_part(h, chr(10), {i})" for i in (1, 2, 3, 4)}}, *cues(d)]


# Words that open a log line, and month names of system logs.
LEVELS = "INFO|WARN|ERROR|DEBUG|TRACE|FATAL|CRITICAL|ALERT"
MONTHS = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
_STAMP = r"^\s*(\[\s*)?[0-9]{4}[-/][0-9]{2}[-/][0-9]{2}"
_LEVEL = rf"(?i)^({LEVELS}|\[\s*({LEVELS})(\]|-|\s|$))"
_STAMPED_LEVEL = rf"(?i)^\s*(\[\s*)?[0-9]{{4}}[-/][0-9]{{2}}[-/][0-9]{{2}}[^\s\]]*[\s\]]+({LEVELS}|\[\s*({LEVELS})(\]|-|\s|$))"
_SYSLOG = rf"^\s*({MONTHS}) +[0-9]{{1,2}} +[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}} +[A-Za-z0-9._-]+ +[^:]{{1,47}}:"


@dataclass(frozen=True)
class TextRule:
    ext: str
    mime: str
    reason: str
    when: str
    confidence: str = "'Low'"  # SQL


def cues(d: Dialect) -> list[dict[str, str]]:
    """What several rules ask, as columns, step by step; each is worked out once for a row."""
    has, n, like = d.has, d.number, d.like
    each = lambda pattern: [like(f"l{i}", pattern) for i in (1, 2, 3, 4)]
    stamps, levels = each(_STAMP), [f"({a} or {b})" for a, b in zip(each(_LEVEL), each(_STAMPED_LEVEL), strict=True)]
    stamp_count, level_count = n(*stamps), n(*levels)
    syslog = [like(f"l{i}", _SYSLOG) for i in (1, 2)]
    verbs = "Get|Set|New|Remove|Add|Invoke|Start|Stop|Import|Export|Write|Test|Enable|Disable|Update|Select|Where|Out|Clear|Copy|Move|Join|Split"
    verb_noun = like("h", f"(^|[^A-Za-z-])({verbs})-[A-Z][A-Za-z]+", java=f"-(?<=(?<![A-Za-z-])(?:{verbs})-)[A-Z][A-Za-z]")  # begins at the rare character
    strong = [
        has("hl", "using module ", "using namespace "), has("hl", "set-strictmode"), has("hl", "$psversiontable"), has("hl", "param(", "param ("), has("hl", "begin{", "begin {"),
        has("hl", "process{", "process {"), has("hl", "end{", "end {"), has("hl", "[parameter("), has("hl", "[validate"), verb_noun,
        f"({has('hl', '| where-object', '| foreach-object', '| select-object')} and {has('h', '$')})",
    ]
    weak = [has("hl", "[cmdletbinding]"), has("hl", "#requires"), *(has("hl", f"write-{x}") for x in "host output error warning verbose debug".split()), has("h", "Import-Module"), has("h", "New-Object"), has("hl", "get-", "set-"), like("h", r"(^|\n)\s*\$[A-Za-z_][A-Za-z0-9_]*\s*=", needs="$")]
    ps_strong, ps_cues = n(*strong), n(*strong, *weak)
    ps = f"({ps_cues} >= 2 or ({ps_cues} >= 1 and {ps_strong} >= 1))"
    js_strong = [has("hl", "function(", "function "), has("hl", "=>"), has("hl", "module.exports", "exports."), like("h", r"^\s*\(?[A-Za-z_$][A-Za-z0-9_$]*\.[A-Za-z_$][A-Za-z0-9_$]*\s*\(")]
    js_weak = [has("hl", "import ", "export "), has("hl", "require("), has("hl", "document.", "window."), has("hl", "class "), has("hl", "const ", "let ", "var ")]
    js = f"(case when {has('hl', 'local function')} then 0 else 3 * {n(*js_strong)} + {n(*js_weak)} + 2 * cast(({has('hl', 'const ', 'let ', 'var ')} and {has('hl', '=')}) as int) end)"
    sh_shebang = has("hl", "#!/bin/sh", "#!/usr/bin/env sh", "#!/usr/bin/env bash", "#!/bin/bash", "#!/usr/bin/env zsh", "#!/bin/zsh")
    bat = f"({has('hl', '@echo off', 'setlocal', 'endlocal', chr(10) + 'goto ', ' goto ', chr(10) + 'rem ', ':end')} or left(hl, 4) = 'rem ')"
    yaml_keys = d.lines("h", 8, r"^[ \t-]*[A-Za-z_][^\s:\x27\x22]*:($|[^/\\])")
    yaml_items = d.lines("h", 8, r"^[ \t]*-[ \t]")
    headers = d.lines("h", 8, r"^[A-Z][A-Za-z0-9 -]{0,39}:([ \t]|$)")
    numbers = {f"s{i}": x for i, x in enumerate(stamps, 1)} | {f"v{i}": x for i, x in enumerate(levels, 1)} | {f"y{i}": x for i, x in enumerate(syslog, 1)}
    first = numbers | {"ps_strong": ps_strong, "ps_weak": n(*weak), "js": js, "sh_shebang": sh_shebang, "bat": bat, "verb_noun": verb_noun, "yaml_keys": yaml_keys, "yaml_items": yaml_items, "headers": headers}
    second = {
        "ps": "(ps_strong + ps_weak >= 2)", "stamp_count": n("s1", "s2", "s3", "s4"), "level_count": n("v1", "v2", "v3", "v4"), "log_cues": "(s1 or s2 or v1 or v2 or y1 or y2)",
        "script": f"(ps_strong + ps_weak >= 2 or js >= 2 or sh_shebang or bat or {has('hl', '#!/usr/bin/env node', '#!/usr/bin/env python', '#!/usr/bin/env ruby', '#!/usr/bin/env lua')})",
    }
    first |= {
        "flat": "translate(h, concat(' ', chr(9), chr(10), chr(13)), '')", "markup": "(contains(h, '<') and contains(h, '>'))", "qp_header": has("hl", "content-transfer-encoding: quoted-printable"),
        "qp_escapes": d.count("h", "=[0-9A-Fa-f][0-9A-Fa-f]"), "qp_breaks": d.count("h", "=\\r?\\n"),
    }
    # runs pass over blanks; a line's worth of letters in one piece keeps prose without punctuation apart
    dense, pairs = like("h", "[A-Za-z0-9+/=_-]{60}"), like("h", "([0-9A-Fa-f]{2,8}[ \\t\\r\\n]+){16}")
    second |= {"flat_run": f"(({dense} or {pairs}) and {like('flat', '[A-Za-z0-9+/=_-]{128}')})", "dense": dense}
    letters = lambda when, pattern: f"(case when {when} then length(flat) - length({d.strip('flat', pattern)}) else 0 end)"
    third = {"flat_hex": letters("flat_run", "[0-9A-Fa-f]"), "flat_64": letters("flat_run", "[A-Za-z0-9+/=_-]"), "qp_plain": letters("decl = 'qp' or qp_escapes >= 2 or qp_breaks >= 1", "[!-~]")}
    return [first, second, third]


def rules(d: Dialect) -> list[TextRule]:
    has, n, like = d.has, d.number, d.like
    many = lambda line, c: f"(length({line}) - length(replace({line}, {d.text(c)}, '')))"
    pair = lambda c: f"({many('l1', c)} >= 1 and {many('l2', c)} >= 1 and abs({many('l1', c)} - {many('l2', c)}) <= 2)"
    alone = lambda c: f"(l2 = '' and {many('l1', c)} >= 2 and not {like('l1', '=|://|^[-/][A-Za-z]|[A-Za-z]:[/]')} and {d.count('l1', f'(^|[{c}])[A-Za-z0-9 _.()-]*[A-Za-z0-9][A-Za-z0-9 _.()-]*')} >= 3)"
    # an object on one line: as many braces open as close, and a colon, both outside quotes; a quote before the first colon, a brace after it
    bare = lambda line: d.strip(line, '"[^"]*("|$)')
    first = lambda line, c: f"instr({line}, '{c}')"
    json_line = lambda line: (
        f"({like(line, '^[ \\t\\r]*[{]')} and {first(line, ':')} > {first(line, chr(34))} and {first(line, chr(34))} > 0 and length({line}) - instr(reverse({line}), '}}') + 1 > {first(line, ':')} and contains({line}, '}}')"
        f" and {d.count(bare(line), '[{]')} = {d.count(bare(line), '[}]')} and contains({bare(line)}, ':'))"
    )
    quoted_key = like("left(h, 2048)", r'"[^"\n\r]*"\s*:')
    yaml_ok = f"not {has('h', 'Log Name:', 'Event ID:', 'Source:', 'Task Category:', 'Level:')} and not (headers >= 2 and headers >= yaml_keys) and (yaml_keys >= 2 or yaml_items >= 3 or (yaml_keys >= 1 and yaml_items >= 1) or not ps)"
    headings = f"(left(hl, 2) = '# ' or {has('hl', chr(10) + '# ')})"
    md_cues = n(headings, has("hl", "```"), has("hl", "]("), f"(left(hl, 2) in ('- ', '* ') or {has('hl', chr(10) + '- ', chr(10) + '* ')})")
    printable = d.count("left(h, 2048)", r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]")
    armor = like("h", r"(^|\n)-----BEGIN PGP (MESSAGE|PUBLIC KEY BLOCK|SIGNATURE|PRIVATE KEY BLOCK)-----", needs="-----BEGIN ")
    python = f"({n(has('h', 'import '), f'''({has('h', 'def ')} and {has('h', ':')})''', f'''({has('h', 'class ')} and {has('h', ':')})''')} + 2 * cast({like('h', 'if __name__ == .__main__.:')} as int))"
    ends = has("h", " end")
    ruby = f"({n(has('h', 'require '), has('h', 'puts '))} + 2 * {n(*(f'''({has('h', x)} and {ends})''' for x in ('def ', 'class ', 'module ')))})"
    lua = f"({n(has('h', 'require(', 'require '), f'''({has('h', ' then')} and {ends})''')} + 2 * {n(has('h', 'local function '), f'''({has('h', 'function ')} and {ends})''')})"
    level = lambda many: f"case when {many} then 'Medium' else 'Low' end"
    return [
        TextRule("rtf", "application/rtf", "text:rtf", "left(h, 5) = " + d.text("{\\rtf"), "'Medium'"),
        TextRule("b85", "application/x-ascii85", "text:b85", f"left(h, 2) = '<~' and {has('h', '~>')}"),
        TextRule("uu", "text/x-uuencode", "text:uu", f"left(hl, 6) = 'begin ' and {has('hl', chr(10) + 'end')}"),
        TextRule("qp", "message/quoted-printable", "text:quoted-printable", f"not markup and (decl = 'qp' or case when qp_header then qp_escapes >= 2 or qp_breaks >= 1 else (qp_breaks >= 1 and qp_escapes >= 2) or qp_escapes >= 6 end) and length(flat) > 0 and qp_plain >= floor(0.75 * length(flat))", "case when decl = 'qp' or qp_header then 'Medium' else 'Low' end"),
        TextRule("b64", "application/base64", "text:base64", f"not script and not markup and not {has('hl', '-----begin ')} and not log_cues and not (flat_hex >= floor(0.95 * length(flat)) and not {like('flat', '[=_-]')}) and dense and flat_run and flat_64 >= floor(0.92 * length(flat)) and ({like('flat', '[=_-]')} or ({like('flat', '[A-Za-z0-9+/=_-]{256}')} and flat_64 >= floor(0.98 * length(flat))))"),
        TextRule("hex", "text/plain", "text:hex", f"not script and not log_cues and flat_run and {like('flat', '[0-9A-Fa-f]{160}')} and flat_hex > 4 * (length(flat) - flat_hex)"),
        TextRule("ndjson", "application/x-ndjson", "text:ndjson", f"{json_line('l1')} and {json_line('l2')}", level(json_line("l3"))),
        TextRule("json", "application/json", "text:json", f"left(h, 1) = '[' and not s1 and not v1 and {like('h', '^.[ \\t\\r\\n]*[-{\\[\\]0-9tfn\\x22]')} and (({has('left(h, 2048)', '{')} and {quoted_key}) or (not {has('left(h, 2048)', '{')} and {has('left(h, 2048)', ',')} and {has('left(h, 2048)', ']')}))", level(has("left(h, 2048)", "{"))),
        TextRule("json", "application/json", "text:json", "left(h, 1) = '{' and " + quoted_key + " and " + has("left(h, 2048)", "}"), "'Medium'"),
        TextRule("admx", "application/xml", "text:admx", f"left(h, 1) = '<' and {like('hl', '<([a-z0-9_]+:)?policydefinitions[ >]')}", "'Medium'"),
        TextRule("adml", "application/xml", "text:adml", f"left(h, 1) = '<' and {like('hl', '<([a-z0-9_]+:)?policydefinitionresources[ >]')}", "'Medium'"),
        TextRule("xml", "application/xml", "text:xml", "left(h, 5) = '<?xml'", "'Medium'"),
        TextRule("html", "text/html", "text:html", f"left(h, 1) = '<' and {has('h', '<!DOCTYPE html', '<html')}", "'Medium'"),
        TextRule("asc", "application/pgp", "text:pgp", armor, "'Medium'"),
        TextRule("crt", "application/pkix-cert", "text:pem-cert", like("h", r"(^|\n)-----BEGIN CERTIFICATE-----", needs="-----BEGIN "), "'Medium'"),
        TextRule("csr", "application/pkcs10", "text:pem-csr", like("h", r"(^|\n)-----BEGIN (NEW )?CERTIFICATE REQUEST-----", needs="-----BEGIN "), "'Medium'"),
        TextRule("key", "application/x-pem-key", "text:pem-key", like("h", r"(^|\n)-----BEGIN (RSA |EC |DSA |OPENSSH |ENCRYPTED )?PRIVATE KEY-----", needs="-----BEGIN "), "'Medium'"),
        TextRule("yml", "application/x-yaml", "text:yaml", f"left(h, 3) = '---' and (yaml_keys + yaml_items) > 0 and {yaml_ok}"),
        TextRule("yml", "application/x-yaml", "text:yaml-keys", f"left(h, 3) <> '---' and (yaml_keys >= 2 or yaml_items >= 2) and {yaml_ok}"),
        TextRule("toml", "application/toml", "text:toml", f"{d.lines('h', 20, '^\\[\\[?[A-Za-z0-9_-]+([.][A-Za-z0-9_-]+)+\\]\\]?[ ]*$')} >= 1 and {d.lines('h', 20, '^[A-Za-z0-9_-]+ *= *([0-9tf{]|\\[|[^A-Za-z0-9 ])')} >= 1 and {d.lines('h', 20, '^;')} = 0"),
        TextRule("eml", "message/rfc822", "text:eml", f"{d.lines('h', 20, '^(From|To|Subject|Date|Message-ID|MIME-Version|Content-Type|Received|Return-Path|Reply-To|Cc):')} >= 2 and {d.lines('h', 20, '^(From|To|Subject|Message-ID):')} >= 1 and {d.lines('h', 40, '^.?$')} >= 1"),
        TextRule("msg", "application/vnd.ms-outlook", "text:msg-marker", has("h", "__substg1.0_")),
        TextRule("log", "text/plain", "text:log-dns", f"{has('hl', 'dns server log')} and {has('hl', 'log file created at', 'packet')}", "'Medium'"),
        TextRule("log", "text/plain", "text:log-powershell-transcript", f"{has('hl', 'windows powershell transcript start')} and {has('hl', 'start time:', 'username:', 'machine:')}", "'Medium'"),
        TextRule("log", "text/plain", "text:log-path-errors", f"decl = 'log' and not script and {logs.path_errors(d)}"),
        TextRule("log", "text/plain", "text:log-syslog", f"not script and y1 and y2", "'Medium'"),
        TextRule("log", "text/plain", "text:log-levels", f"not script and stamp_count >= 3 and level_count >= 2", "'Medium'"),
        TextRule("log", "text/plain", "text:log", f"not script and s1 and s2 and level_count = 0"),
        TextRule("log", "text/plain", "text:log", f"not script and stamp_count >= 2 and level_count = 0"),
        TextRule("log", "text/plain", "text:log-levels", f"not script and stamp_count >= 2", "'Medium'"),
        TextRule("log", "text/plain", "text:log-levels", f"not script and (level_count >= 2 or ((s1 or s2) and level_count >= 1))", level(f"(level_count >= 2 and (s1 or s2))")),
        TextRule("log", "text/plain", "text:log", f"not script and decl = 'log' and (log_cues or level_count > 0)"),
        TextRule("tsv", "text/tab-separated-values", "text:tsv", f"left(hl, 4) = 'sep=' and (substr(h, 5, 1) = chr(9) or substr(h, 5, 2) = {d.text(chr(92) + 't')}) and not log_cues and not script"),
        TextRule("csv", "text/csv", "text:csv", f"left(hl, 4) = 'sep=' and not log_cues and not script"),
        TextRule("csv", "text/csv", "text:csv", f"not log_cues and not script and ({pair(',')} or {pair(';')} or {pair('|')})"),
        TextRule("tsv", "text/tab-separated-values", "text:tsv", f"not log_cues and not script and {pair(chr(9))}"),
        TextRule("csv", "text/csv", "text:csv", f"not log_cues and not script and ({alone(',')} or {alone(';')})"),
        TextRule("ini", "text/plain", "text:ini", f"not ps and js < 2 and not sh_shebang and not bat and {d.lines('h', 8, '^[ ]*\\[[A-Za-z0-9 _.-]+\\][ ]*($|[;#])')} >= 1 and {d.lines('h', 8, '^[^;#=][^=]*=')} >= 1"),
        TextRule("md", "text/markdown", "text:md", f"({headings} or {has('hl', '```', '](')}) and not log_cues and ({md_cues} >= 2 or ({md_cues} = 1 and (decl = 'md' or trim(l2) <> ''))) and (not script or decl = 'md' or {headings} or {has('hl', '```')})"),
        *(TextRule("log", "text/plain", reason, f"not script and {holds}", f"'{confidence}'") for reason, holds, confidence in logs.families(d)),
        TextRule("ps1", "text/x-powershell", "text:ps1-shebang", has("hl", "#!/usr/bin/env pwsh", "#!/usr/bin/pwsh", "#!/usr/bin/env powershell", "#!/usr/bin/powershell"), "'Medium'"),
        TextRule("psm1", "text/x-powershell", "text:psm1", f"decl = 'psm1' and ({has('hl', 'export-modulemember', 'functionstoexport', 'rootmodule')} or verb_noun)", "'High'"),
        TextRule("psd1", "text/x-powershell", "text:psd1", f"decl = 'psd1' and (left(h, 2) = '@{{' or {has('hl', 'export-modulemember', 'functionstoexport', 'rootmodule')})"),
        TextRule("ps1", "text/x-powershell", "text:ps1", "ps", level(f"ps_strong + ps_weak >= 3")),
        TextRule("vbs", "text/vbscript", "text:vbs", has("hl", "wscript.", "createobject(", "vbscript", "dim ", "end sub", "option explicit", "on error resume next", "msgbox"), level(has("hl", "option explicit", "on error resume next", "createobject(", "wscript."))),
        TextRule("sh", "text/x-shellscript", "text:sh-shebang", "sh_shebang", "'Medium'"),
        TextRule("js", "application/javascript", "text:node-shebang", has("hl", "#!/usr/bin/env node", "#!/usr/bin/node"), "'Medium'"),
        TextRule("js", "application/javascript", "text:js-heur", f"js >= 2 and left(h, 1) not in ('{{', '[')", level(f"js >= 5")),
        TextRule("sh", "text/x-shellscript", "text:sh-heur", f"js < 2 and {has('hl', 'set -e', 'set -u', 'export ', '[[', ']]')} and {has('hl', ' fi' + chr(10), ' esac' + chr(10), ' && ', ' case ', '  do' + chr(10))}"),
        TextRule("cmd", "text/x-batch", "text:cmd", f"decl = 'cmd' and js < 2 and bat", "'Medium'"),
        TextRule("bat", "text/x-batch", "text:bat", f"js < 2 and bat", "'Medium'"),
        TextRule("py", "text/x-python", "text:py-shebang", has("hl", "#!/usr/bin/env python", "#!/usr/bin/python"), "'Medium'"),
        TextRule("py", "text/x-python", "text:py-heur", f"js < 2 and {python} >= 2", level(f"{python} >= 4")),
        TextRule("rb", "text/x-ruby", "text:rb-shebang", has("hl", "#!/usr/bin/env ruby", "#!/usr/bin/ruby"), "'Medium'"),
        TextRule("rb", "text/x-ruby", "text:rb-heur", f"js < 2 and {ruby} >= 2", level(f"{ruby} >= 4")),
        TextRule("lua", "text/x-lua", "text:lua-shebang", has("hl", "#!/usr/bin/env lua", "#!/usr/bin/lua"), "'Medium'"),
        TextRule("lua", "text/x-lua", "text:lua-heur", f"js < 2 and {lua} >= 2", level(f"{lua} >= 4")),
        TextRule("txt", "text/plain", "text:plain", f"length(h) >= 4 and {printable} <= 0.02 * length(left(h, 2048))"),
    ]


def number_sql(d: Dialect) -> str:
    """The number of the first rule that holds, null if none does."""
    return "case " + " ".join(f"when {r.when} then {i}" for i, r in enumerate(rules(d))) + " end"


def confidence_sql(d: Dialect, number: str) -> str:
    """The confidence of the rule of that number."""
    return f"case {number} " + " ".join(f"when {i} then {r.confidence}" for i, r in enumerate(rules(d))) + " end"


def field_sql(number: str, field: str) -> str:
    """``ext``, ``mime`` or ``reason`` of the rule of that number."""
    return f"case {number} " + " ".join(f"when {i} then '{getattr(r, field)}'" for i, r in enumerate(rules(Dialect()))) + " end"
