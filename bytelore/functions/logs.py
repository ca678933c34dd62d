"""Families of text logs by weighted markers, lines of path errors, and how much a text is a log at all."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dialect import Dialect

# Labels of exported events, and how a line that tells of a path's error goes on after the path.
EVENT_LABELS = ["log name:", "source:", "event id:", "task category:", "level:", "keywords:", "user:", "computer:", "description:", "date:"]
PATH_ERRORS = ["access is denied", "cannot find", "the system cannot", "permission denied"]
#: A path with a drive or a share, then a colon and an error, in lower case.
PATH_ERROR_LINE = rf"^\s*([a-z]:[\x5C/][^:]*|\x5C\x5C[^:]*):\s*({'|'.join(PATH_ERRORS)})"


def families(d: Dialect) -> list[tuple[str, str, str]]:
    """Reason, whether it holds, and confidence of each family, over ``hl`` (the head in lower case) and ``log_cues``."""
    has, n = lambda *m: d.has("hl", *m), d.number
    every = lambda *m: "(" + " and ".join(has(x) for x in m) + ")"
    dated = f"({has('#fields:')} and {has('#version:', '#date:')})"
    net = n("log_cues", has("netlogon"), d.like("hl", "(?s)netlogon.*netlogon"), has("netrlogon"), has("netrlogon"), has("secure channel"), has("sam logon"))
    export = f"({every('log name:', 'event id:')} or {every('source:', 'task category:', 'level:')})"
    provider, by_name = has("microsoft-windows-windows defender"), has("windows defender", "microsoft defender")
    known = has("security intelligence", "signature version", "engine version", "platform version")
    weights = n(has("mpcmdrun"), has("mpcmdrun"), provider, provider, by_name, has("antivirus"), has("antimalware"), has("threat"), has("remediation", "quarantine"), known)
    defender = f"({weights} + case when {export} and ({provider} or {by_name}) then 2 else 0 end)"
    sql = n("log_cues", has("sql server"), has("sql server is starting"), has("errorlog"), has("spid"), has("server process id"))
    agent = n(has("sqlserveragent"), has("startup", "started", "starting"), has("version"), has("job"), has("service"), "log_cues")
    return [
        ("text:log-firewall", f"{has('microsoft windows firewall', '#software: windows firewall')} and {every('#fields:', 'date', 'time')}", "Medium"),
        ("text:log-netlogon", f"{has('netlogon', 'secure channel', 'sam logon')} and ({net} >= 3 or ({net} >= 2 and {has('netrlogon', 'secure channel', 'sam logon')}))", "Medium"),
        ("text:event-txt", f"{has('event id:', 'log name:')} and {n(*(has(x) for x in EVENT_LABELS))} >= 3", "Medium"),
        ("text:log-dhcp", f"{has('#software: microsoft dhcp server')} and {dated}", "Medium"),
        ("text:log-exchange", f"{has('#log-type: message tracking log', 'message tracking log file')} and {has('#fields:')} and {has('#software: microsoft exchange', '#version:')}", "Medium"),
        (
            "text:log-defender",
            f"({provider} or {has('antivirus', 'antimalware')} or {known} or {export}) and (log_cues or {export} or {has('mpcmdrun')} or {provider}) and {defender} >= case when {has('mpcmdrun')} then 4 else 3 end",
            "Low",
        ),
        ("text:log-sql-errorlog", f"{has('sql server')} and {has('spid', 'server process id')} and {sql} >= 2", "Medium"),
        ("text:log-nps", f"{has('#software: microsoft internet authentication service', '#software: microsoft network policy server')} and {dated}", "Medium"),
        ("text:log-sqlagent", f"{has('sqlserveragent', 'sql server agent')} and {agent} >= 2", "Low"),
    ]


def path_errors(d: Dialect) -> str:
    """Whether three of the first 80 lines tell of an error of a path."""
    return f"{d.lines('hl', 80, PATH_ERROR_LINE)} >= 3"


def log_class(text: Column) -> Column:
    """``is_log, info, warn, error`` over the first 800 lines: exported events, three stamped lines of ten or more, five
    lines with levels, or three path errors make a log.  Null and empty texts are none."""
    lines = F.transform(F.slice(F.split(F.upper(F.coalesce(text, F.lit(""))), "\r?\n"), 1, 800), F.trim)
    count = lambda pattern: F.size(F.filter(lines, lambda x: x.rlike(pattern)))
    info, warn, error = count("INFO"), count("WARN"), count("ERROR|ERR ")
    exported = F.exists(lines, lambda x: x.contains("LOG NAME:") & x.rlike("EVENT ID:|TASK CATEGORY:|LEVEL:"))
    total = F.size(lines) - F.when(F.element_at(lines, -1) == "", 1).otherwise(0)
    broken = F.size(F.filter(lines, lambda x: F.lower(x).rlike(PATH_ERROR_LINE)))
    is_log = exported | ((count("^[0-9]{4}-[0-9]") >= 3) & (total >= 10)) | (info + warn + error >= 5) | (broken >= 3)
    return F.struct(is_log.alias("is_log"), info.alias("info"), warn.alias("warn"), error.alias("error"))
