"""Security findings of text: scripts, logs, hosts, shares and secrets, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Markers of each script finding, in the order in which findings are listed; one is enough.
SCRIPT_MARKERS = {
    "ps:encoded": ["frombase64string(", "encodedcommand", "-enc "], "ps:iex": ["invoke-expression", "iex ", "iex\n", "iex\t"],
    "ps:web-dl": ["invoke-webrequest", "invoke-restmethod", "downloadstring(", "new-object system.net.webclient"], "ps:reflection": ["add-type", "reflection.assembly"],
    "py:exec-b64": ["b64decode("], "py:exec": ["subprocess.popen(", "os.system("], "rb:eval": ["eval(", "kernel.exec(", "open-uri"], "lua:exec": ["loadstring(", "os.execute("],
    "bat:certutil": ["certutil -decode", "certutil.exe -decode"], "js:activex": ["wscript.shell", "activexobject", "adodb.stream"], "js:mshta": ["mshta ", "mshta.exe"],
}
#: What must occur beside a marker.
ALSO = {"py:exec-b64": "exec("}
# Markers that must all occur, of logs and other known texts.
KNOWN_TEXTS = {
    "log:iis-w3c": ["#fields:", "#software: microsoft internet information services"], "event-xml": ["<event ", "http://schemas.microsoft.com/win/2004/08/events/event"],
    "sysmon": ["microsoft-windows-sysmon"], "ldif": ["ldif-version:", "\ndn:"], "event:txt": ["log name:", "event id:", "source:"],
}
KEY_BLOCKS = ["rsa private key", "private key", "dsa private key", "openssh private key", "encrypted private key", "ec private key"]
# Token families, the form of their tokens, and whether letters match in either case.
TOKENS = {
    "github": (r"github_pat_[A-Za-z0-9_]{50,180}|gh[pousr]_[A-Za-z0-9]{30,80}", False), "gitlab": (r"glpat-[A-Za-z0-9_-]{16,80}", False), "aws-akid": (r"A[KS]IA[A-Z0-9]{16}", False),
    "slack": (r"xox[bpasr]-[A-Za-z0-9-]{16,160}", False), "stripe": (r"[sr]k_live_[A-Za-z0-9]{16,120}", False), "gcp-apikey": (r"AIza[A-Za-z0-9_-]{35}", False), "npm": (r"npm_[A-Za-z0-9]{24,80}", False),
}
#: Words that must stand within 64 characters of a token that is no secret by its form alone.
CONTEXT = ["token", "secret", "api_key", "apikey", "access_key", "accesskey", "authorization", "bearer", "credential", "key=", "password="]
PLACEHOLDERS = ["example", "sample", "placeholder", "dummy", "changeme", "notreal", "not_real", "replace", "token_here", "secret_here", "key_here", "your_", "yourapikey", "yourtoken", "yoursecret"]
# Letters that every token of a family has; texts without them need no expression.
LITERALS = {"github": ["github_pat_", "ghp_", "gho_", "ghu_", "ghs_", "ghr_"], "gitlab": ["glpat-"], "aws-akid": ["AKIA", "ASIA"], "slack": ["xox"], "stripe": ["k_live_"], "gcp-apikey": ["AIza"], "npm": ["npm_"]}
_BODY = "A-Za-z0-9_-"


def contains_any(lower: Column, needles: list[str]) -> Column:
    out = F.lit(False)
    for x in needles:
        out = out | F.contains(lower, F.lit(x))
    return out


def script_findings(text: Column, declared: Column | None = None) -> Column:
    """Codes of script findings, in a fixed order, without repeats; empty for null."""
    low = F.lower(text)
    found = [F.when(contains_any(low, m) & (F.contains(low, F.lit(ALSO[c])) if c in ALSO else F.lit(True)), F.lit(c)) for c, m in SCRIPT_MARKERS.items()]
    bursts = F.when(F.regexp_count(low, F.lit(r"fromcharcode\(")) > 20, F.lit("js:fromcharcode"))
    kinds = ["ps1", "psm1", "psd1", "sh", "bash", "zsh", "bat", "cmd", "js", "rb", "py", "lua"]
    risky = F.when(declared.isin(kinds), F.lit("script:dangerous-kind")) if declared is not None else F.lit(None).cast("string")
    return F.array_compact(F.array(*found, bursts, risky))


def text_findings(text: Column) -> Column:
    """Codes of known kinds of log and export."""
    low = F.lower(text)
    all_of = lambda needles: F.when(F.forall(F.array(*(F.contains(low, F.lit(n)) for n in needles)), lambda x: x), F.lit(True))
    return F.array_compact(F.array(*(F.when(all_of(m), F.lit(c)) for c, m in KNOWN_TEXTS.items())))


def hosts(text: Column) -> Column:
    """Distinct hosts of web addresses, lower case, sorted."""
    urls = F.regexp_extract_all(text, F.lit(r"(?i)https?://([A-Za-z0-9._-]+)"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(urls, F.lower)))


def shares(text: Column) -> Column:
    r"""Distinct ``\\server\share`` names, lower case, sorted."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"(\\\\[A-Za-z0-9._-]+\\[A-Za-z0-9._$-]+)"), F.lit(1)), F.lower)))


def is_allowed(host: Column, domains: list[str]) -> Column:
    """Whether a host is one of the domains or below one."""
    out = F.lit(False)
    for d in domains:
        name = d.strip().lower().removeprefix("*.").lstrip(".")
        if name:
            out = out | (F.lower(host) == name) | F.lower(host).endswith("." + name)
    return out


def network_findings(text: Column, internal: list[str] = ()) -> Column:
    """Counts of shares, drive mappings and hosts, as ``code=count``."""
    low = F.lower(text)
    found, named = shares(text), F.array_sort(F.array_distinct(F.concat(hosts(text), F.transform(shares(text), lambda s: F.element_at(F.split(s, r"\\"), 3)))))
    inside = F.size(F.filter(named, lambda h: is_allowed(h, list(internal))))
    mapped = F.regexp_count(low, F.lit("net use |new-psdrive "))
    say = lambda code, n: F.when(n > 0, F.concat(F.lit(f"{code}="), n.cast("string")))
    return F.array_compact(F.array(say("net:unc", F.size(found)), say("net:map", mapped), say("net:hosts", F.size(named)), say("net:hosts-int", inside), say("net:hosts-ext", F.size(named) - inside)))


def private_keys(text: Column) -> Column:
    """Key blocks that begin in the text, 32 at most (a fixed limit of the score)."""
    n = F.regexp_count(F.lower(text), F.lit(f"-----begin ({'|'.join(KEY_BLOCKS)})-----"))
    return F.least(n, F.lit(32))


def key_patterns(text: Column) -> Column:
    """Assignments of a long, varied value to key, secret, password or pwd, and connection strings with a password, 32 at most."""
    values = F.regexp_extract_all(text, F.lit(r"""(?i)(?:key|secret|password|pwd)=[ "']*([A-Za-z0-9+/=_-]{20,})"""), F.lit(1))
    varied = F.filter(values, lambda v: (F.size(F.array_distinct(F.split(v, ""))) >= 4) & ~F.lower(v).rlike("example|sample|placeholder|changeme|xxxx|your_|dummy"))
    # the 256 characters from the name on hold the password's name; a look ahead, so that windows may overlap
    connections = F.regexp_count(text, F.lit(r"(?is)connectionstring=(?=.{0,230}password=|.{0,235}pwd=)"))
    return F.least(F.size(varied) + connections, F.lit(32))


def azure_sas(text: Column) -> Column:
    """Distinct shared access signatures (``sv=``, ``se=`` or ``sp=``, and a ``sig=`` of 20 to 256 characters) near a word of ``CONTEXT``."""
    # a run without delimiters that has sig=, with what surrounds it; the run is looked ahead at, so that neighbours may share context
    runs = F.regexp_extract_all(text, F.lit(r"""(?i)(?<![^\s"'<>()\[\]])(?=[^\s"'<>()\[\]]*sig=)([^\s"'<>()\[\]]+)"""), F.lit(1))
    token = lambda x: F.regexp_replace(F.regexp_replace(x, r"^[?&]+", ""), r"^[`{},;.]+|[`{},;.]+$", "")

    def near(x: Column) -> Column:
        """Whether any place of the run has a word of ``CONTEXT`` in it or within 64 characters."""
        around = F.concat(F.lit(r"(?is)(?:"), F.lit("|".join(CONTEXT)), F.lit(r")"))
        pieces = F.split(text, F.concat(F.lit(r"\Q"), x, F.lit(r"\E")))
        beside = F.exists(F.transform(pieces, lambda p, i: F.concat(F.when(i > 0, F.left(p, F.lit(64))).otherwise(""), F.lit("\n"), F.when(i < F.size(pieces) - 1, F.right(p, F.lit(64))).otherwise(""))), lambda p: F.regexp_like(p, around))
        return F.regexp_like(x, around) | beside

    def is_sas(x: Column) -> Column:
        t, low = token(x), F.lower(token(x))
        signature = F.regexp_extract(t, r"(?i)^.*?sig=([^&]*)", 1)
        return (
            F.length(t).between(24, 512) & F.contains(low, F.lit("sv=")) & (F.contains(low, F.lit("se=")) | F.contains(low, F.lit("sp=")))
            & signature.rlike(r"^[\p{L}\p{Nd}%+/=._-]{20,256}$") & ~contains_any(low, PLACEHOLDERS) & near(x)
        )

    found = F.size(F.array_distinct(F.transform(F.filter(runs, is_sas), token)))
    return F.when(text.isNotNull(), F.when(F.contains(F.lower(text), F.lit("sig=")), found).otherwise(0))


def tokens(text: Column, family: str) -> Column:
    """Distinct tokens of a family that stand apart from other words."""
    pattern, any_case = TOKENS[family]
    found = F.size(F.array_distinct(F.regexp_extract_all(text, F.lit(rf"{'(?i)' if any_case else ''}(?<![{_BODY}])(?:{pattern})(?![{_BODY}])"), F.lit(0))))
    return F.when(text.isNotNull(), F.when(contains_any(text, LITERALS[family]), found).otherwise(0))


def redact(token: Column, head: int = 4, tail: int = 4) -> Column:
    """A token with its middle starred out; short ones wholly."""
    n = F.length(token)
    return F.when(n <= head + tail, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.left(token, F.lit(head)), F.repeat(F.lit("*"), n - head - tail), F.right(token, F.lit(tail))))
