"""References that text holds: commands of tasks and policies, shortcuts, embedded data, and what is odd in their paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bits of what is odd in a path.
UNQUOTED, UNC, ABSOLUTE, RELATIVE, ENVIRONMENT, INSECURE = 1, 2, 4, 8, 16, 32
# Folders that anyone may write to, lower case.
WRITABLE = ["\\temp\\", "\\tmp\\", "\\users\\public\\", "\\appdata\\local\\temp\\", "/tmp/", "/var/tmp/"]
# Extensions by media type of embedded data.
MEDIA = {"text/javascript": "js", "application/javascript": "js", "text/css": "css", "text/html": "html", "image/png": "png", "image/jpeg": "jpg", "image/gif": "gif", "image/svg+xml": "svg", "application/pdf": "pdf", "application/json": "json", "text/plain": "txt", "application/octet-stream": "bin"}


def path_issues(value: Column) -> Column:
    """A bit mask of what is odd in a command or path; 0 for null."""
    bare = F.btrim(value, F.lit("\" "))
    low = F.lower(bare)
    quoted = F.ltrim(value).startswith('"')
    unc, rooted = bare.startswith("\\\\"), bare.rlike(r"^([A-Za-z]:[\\/]|/)")
    env = bare.rlike(r"%[A-Za-z0-9_()]+%|\$\{?[A-Za-z_]")
    writable = F.lit(False)
    for x in WRITABLE:
        writable = writable | F.contains(low, F.lit(x))
    bits = {UNQUOTED: ~quoted & (unc | rooted) & bare.rlike(r"^\S*[\\/]\S* \S+[\\/.]"), UNC: unc, ABSOLUTE: rooted, RELATIVE: ~(unc | rooted | env) & bare.rlike(r"[\\/]"), ENVIRONMENT: env, INSECURE: writable}
    out = F.lit(0)
    for bit, holds in bits.items():
        out = out + F.when(F.coalesce(holds, F.lit(False)), bit).otherwise(0)
    return out


def _reference(kind: str, value: Column, source: str) -> Column:
    return F.struct(F.lit(kind).alias("kind"), value.alias("value"), path_issues(value).alias("issues"), F.lit(source).alias("source_tag"))


def _each(values: Column, kind: str, source: str) -> Column:
    return F.transform(F.filter(F.transform(values, F.trim), lambda v: v != ""), lambda v: _reference(kind, v, source))


def unescaped(text: Column) -> Column:
    """The five named entities of XML."""
    for name, c in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(c))
    return text


def task_references(text: Column) -> Column:
    """Commands and arguments of a scheduled task."""
    part = lambda tag: F.transform(F.regexp_extract_all(text, F.lit(rf"(?is)<(?:\w+:)?{tag}>(.*?)</(?:\w+:)?{tag}>"), F.lit(1)), unescaped)
    return F.concat(_each(part("Command"), "Command", "task:exec"), _each(part("WorkingDirectory"), "FilePath", "task:workdir"), _each(part("Arguments"), "Arguments", "task:args"))


def runs_highest(text: Column) -> Column:
    return F.coalesce(text.rlike(r"(?i)<(\w+:)?RunLevel>\s*HighestAvailable"), F.lit(False))


def policy_references(text: Column) -> Column:
    """Commands and parameters of policy scripts in INI form."""
    part = lambda key: F.regexp_extract_all(text, F.lit(rf"(?im)^\s*[0-9]+{key}\s*=([^\r\n]*)"), F.lit(1))
    return F.concat(_each(part("CmdLine"), "Command", "gpo:scripts-ini"), _each(part("Parameters"), "Arguments", "gpo:scripts-ini"))


def shortcut_references(text: Column) -> Column:
    """The address of an internet shortcut."""
    return _each(F.regexp_extract_all(text, F.lit(r"(?im)^\s*URL\s*=([^\r\n]*)"), F.lit(1)), "Url", "url:shortcut")


def embedded_data(text: Column) -> Column:
    """Commonest extensions of base64 data in the text, as ``ext:count`` joined by commas."""
    kinds = F.transform(F.regexp_extract_all(text, F.lit(r"(?i)data:([a-z]+/[a-z0-9.+-]+);base64,[A-Za-z0-9+/]{4}"), F.lit(1)), F.lower)
    table = F.create_map(*(F.lit(x) for p in MEDIA.items() for x in p))
    exts = F.transform(kinds, lambda k: F.coalesce(F.try_element_at(table, k), F.lit("bin")))
    counts = F.transform(F.array_distinct(exts), lambda e: F.struct((-F.size(F.filter(exts, lambda x: x == e))).alias("less"), e.alias("ext")))
    return F.array_join(F.transform(F.array_sort(counts), lambda c: F.concat(c["ext"], F.lit(":"), (-c["less"]).cast("string"))), ",")


def merged(*lists: Column) -> Column:
    """References of several lists without repeats, in order."""
    return F.array_distinct(F.concat(*lists))


def web_tokens(text: Column) -> Column:
    """How many words are signed web tokens: three parts, of which the first two are JSON objects; 16 at most."""
    words = F.regexp_extract_all(text, F.lit(r"(?<![A-Za-z0-9_.-])[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{6,}(?![A-Za-z0-9_.-])"), F.lit(0))

    def part(word: Column, i: int) -> Column:
        flat = F.translate(F.get(F.split(word, r"\."), F.lit(i)), "-_", "+/")
        raw = F.try_to_binary(F.concat(flat, F.repeat(F.lit("="), F.pmod(-F.length(flat), F.lit(4)))), F.lit("base64"))
        return F.trim(F.try_validate_utf8(raw.cast("string")))

    is_object = lambda s: s.startswith("{") & s.endswith("}") & F.contains(s, F.lit('":'))
    good = F.filter(words, lambda w: F.coalesce(is_object(part(w, 0)) & part(w, 0).rlike('(?i)"(alg|typ|kid|enc)"') & is_object(part(w, 1)), F.lit(False)))
    return F.least(F.size(good), F.lit(16))


# Cues and verbs by which a text is PowerShell.
STRUCTURE = ["[cmdletbinding", "set-strictmode", "$psversiontable", "import-module", "function "]
VERBS = ["get-", "set-", "invoke-", "new-", "remove-", "start-", "stop-", "enable-", "disable-", "update-", "add-"]


def powershell_class(text: Column) -> Column:
    """``Strong``, ``Weak`` or ``None``."""
    low = F.lower(text)
    has = lambda x: F.contains(low, F.lit(x))
    one = lambda c: F.when(c, 1).otherwise(0)
    structure = sum((one(has(x)) for x in STRUCTURE), one(has("param(") | has("param (")) + one(has("#!/") & (has("pwsh") | has("powershell"))))
    verbs = sum((one(has(v)) for v in VERBS), F.lit(0))
    return F.when((structure >= 2) | ((structure >= 1) & (verbs >= 3)), "Strong").when((verbs >= 3) | has("$env:") | has("$psmodulepath"), "Weak").otherwise("None")


def cmdlets(text: Column, most: int = 12) -> Column:
    """Distinct verb-noun names, in order of appearance."""
    names = F.regexp_extract_all(text, F.lit(r"(?i)(?:^|[^A-Za-z0-9_-])((?:get|set|new|remove|add|invoke|start|stop|enable|disable|update|import|export|write|test|select|where|out)-[A-Za-z]{3,})"), F.lit(1))
    return F.slice(F.array_distinct(F.transform(names, F.lower)), 1, most)
