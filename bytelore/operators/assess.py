"""A risk score of findings: an ordered fold of weights, a decision for each profile, and what drove it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.types import is_dangerous

# Code and weight of each finding.
FINDINGS = {
    "ps:encoded": ("Script.Encoded", 25), "ps:iex": ("Script.IEX", 20), "ps:web-dl": ("Script.WebDownload", 15), "ps:reflection": ("Script.Reflection", 10), "bat:certutil": ("Script.CertutilDecode", 15),
    "js:mshta": ("Script.Mshta", 20), "js:activex": ("Script.ActiveX", 15), "js:fromcharcode": ("Script.FromCharCode", 10), "py:exec-b64": ("Script.PyExecB64", 20), "py:exec": ("Script.PyExec", 10),
    "rb:eval": ("Script.RbEval", 10), "lua:exec": ("Script.LuaExec", 10), "secret:privkey": ("Secret.PrivateKey", 40), "secret:jwt": ("Secret.JWT", 25), "secret:keypattern": ("Secret.KeyPattern", 15),
    "secret:token": ("Secret.TokenFamily", 30), "secret:token:github": ("Secret.TokenFamily.GitHub", 32), "secret:token:gitlab": ("Secret.TokenFamily.GitLab", 28),
    "secret:token:aws-akid": ("Secret.TokenFamily.AwsAccessKeyId", 14), "secret:token:slack": ("Secret.TokenFamily.Slack", 32), "secret:token:stripe": ("Secret.TokenFamily.Stripe", 32),
    "secret:token:gcp-apikey": ("Secret.TokenFamily.GcpApiKey", 16), "secret:token:npm": ("Secret.TokenFamily.Npm", 28), "secret:token:azure-sas": ("Secret.TokenFamily.AzureSas", 30),
    "archive:inner-script-encoded": ("Archive.InnerScriptEncoded", 10), "archive:inner-script-exec": ("Archive.InnerScriptExec", 15), "archive:inner-script-download": ("Archive.InnerScriptDownload", 15),
    "archive:inner-external-hosts": ("Archive.InnerExternalHosts", 5), "archive:inner-unc": ("Archive.InnerUncShares", 5), "archive:inner-disguised-script": ("Archive.InnerDisguisedScript", 10),
    "sig:mkatz": ("Sig.MimikatzEncodedHint", 30), "sig:X1001": ("Sig.MimikatzEncodedHint", 30), "sig:sekurlsa": ("Sig.SekurlsaEncodedHint", 30), "sig:X1002": ("Sig.SekurlsaEncodedHint", 30),
    "sig:X1006": ("Sig.SekurlsaEncodedHint", 30), "sig:X1003": ("Sig.DCSyncEncodedHint", 30), "sig:X1004": ("Sig.InvokeMimikatzHint", 30), "sig:X1005": ("Sig.ProcdumpHint", 20),
    "net:unc": ("Script.UncShares", 5), "net:map": ("Script.NetworkDriveMapping", 5), "net:hosts-ext": ("Script.ExternalHosts", 10),
}
# Name, code and weight of each content flag.
FLAGS = {
    "archive_path_traversal": ("Archive.PathTraversal", 40), "archive_symlinks": ("Archive.Symlink", 20), "archive_absolute_paths": ("Archive.AbsolutePath", 15),
    "contains_executables": ("Archive.ContainsExecutables", 25), "contains_scripts": ("Archive.ContainsScripts", 20), "contains_installers": ("Archive.ContainsInstallers", 25),
    "contains_archives": ("Archive.ContainsArchives", 15), "disguised_executables": ("Archive.DisguisedExecutables", 25), "ooxml_macros": ("Office.Macros", 30), "pdf_javascript": ("Pdf.JavaScript", 20),
    "pdf_open_action": ("Pdf.OpenAction", 15), "pdf_launch": ("Pdf.Launch", 20), "pdf_names_tree": ("Pdf.NamesTree", 10), "pdf_xfa": ("Pdf.Xfa", 10), "pdf_encrypted": ("Pdf.Encrypted", 10),
    "archive_encrypted_entries": ("Archive.EncryptedEntries", 10), "ooxml_encrypted": ("Office.Encrypted", 15), "pdf_many_updates": ("Pdf.ManyUpdates", 5), "office_external_links": ("Office.ExternalLinks", 5),
    "html_external_links": ("Html.ExternalLinks", 5), "office_remote_template": ("Office.RemoteTemplate", 25), "office_possible_dde": ("Office.PossibleDde", 15), "pe_packed": ("PE.PackerSuspect", 20),
    "pe_no_aslr": ("PE.NoASLR", 15), "pe_no_nx": ("PE.NoNX", 20), "pe_no_cfg": ("PE.NoCFG", 15), "pe_no_high_entropy": ("PE.NoHighEntropyVA", 5), "strong_name": ("DotNet.StrongName", -5), "no_strong_name": ("DotNet.NoStrongName", 5),
}
#: Flags that are weighed after what is encoded.
LATER_FLAGS = ["pe_packed", "pe_no_aslr", "pe_no_nx", "pe_no_cfg", "pe_no_high_entropy", "strong_name", "no_strong_name"]
# Extensions that count as programs and as scripts where they are encoded or embedded, and packages of applications.
PROGRAMS = ["exe", "dll", "sys", "ocx", "cpl", "scr", "com", "pif", "msi", "msp", "msix", "appx"]
SCRIPT_TYPES = ["ps1", "psm1", "psd1", "bat", "cmd", "sh", "bash", "zsh", "js", "vbs", "vbe", "wsf", "wsh", "py", "rb"]
APP_PACKAGES = ["appx", "msix"]
ARCHIVE_RISKS = ["contains_executables", "contains_scripts", "contains_installers", "disguised_executables"]
# For counts of secrets, the weight of each one more and the most that these add.
VOLUMES = {
    "Secret.PrivateKey": (8, 24), "Secret.JWT": (4, 16), "Secret.KeyPattern": (2, 12), "Secret.TokenFamily": (4, 20), "Secret.TokenFamily.GitHub": (4, 16), "Secret.TokenFamily.GitLab": (3, 14),
    "Secret.TokenFamily.AwsAccessKeyId": (2, 10), "Secret.TokenFamily.Slack": (4, 16), "Secret.TokenFamily.Stripe": (4, 16), "Secret.TokenFamily.GcpApiKey": (2, 10), "Secret.TokenFamily.Npm": (3, 14),
    "Secret.TokenFamily.AzureSas": (4, 16),
}
WARN, BLOCK = 40, 70
PROFILES = {"strict": -10, "balanced": 0, "lenient": 10}


def _factor(code: Column | str, weight: Column | int) -> Column:
    return F.struct((F.lit(code) if isinstance(code, str) else code).alias("code"), (F.lit(weight) if isinstance(weight, int) else weight).cast("int").alias("weight"))


def _has(names: Column, some: list[str]) -> Column:
    return F.coalesce(F.exists(names, lambda n: n.isin(some)), F.lit(False))


def finding_factors(findings: Column, flags: Column | None = None) -> Column:
    """Factors of findings, in their order, each code once; counts such as ``net:unc=3`` weigh as their code.

    ``tool:`` says nothing new of an archive whose contents count by themselves (``flags``).
    """
    table = F.create_map(*(x for f, (code, weight) in FINDINGS.items() for x in (F.lit(f), _factor(code, weight))))
    specific = F.exists(findings, lambda f: f.startswith("secret:token:"))
    counted = F.lit(False) if flags is None else _has(flags, ARCHIVE_RISKS)
    tool = lambda f: F.when(~counted, _factor("Tool.Indicator", 10))
    weighed = F.transform(findings, lambda f: F.when(f.startswith("tool:"), tool(f)).when(~((f == "secret:token") & specific), F.try_element_at(table, F.element_at(F.split(f, "="), 1))))
    return F.array_distinct(F.array_compact(weighed))


def flag_factors(flags: Column, subtype: Column | None = None, names: list[str] | None = None) -> Column:
    """Factors of an array of flag names, in the order of ``FLAGS``; ``names``: only of these.

    Programs within count once: not beside disguised ones or installers.  In a package of an application (``subtype``)
    programs and scripts are what one expects.
    """
    package = F.lit(False) if subtype is None else F.coalesce(F.lower(subtype).isin(APP_PACKAGES), F.lit(False))
    silent = {"contains_executables": package | _has(flags, ["disguised_executables", "contains_installers"]), "contains_scripts": package}
    held = lambda name: F.array_contains(flags, name) & ~silent.get(name, F.lit(False))
    return F.array_compact(F.array(*(F.when(held(name), _factor(*FLAGS[name])) for name in (FLAGS if names is None else [n for n in FLAGS if n in names]))))


def encoded_factors(kind: Column, inner: Column, findings: Column) -> Column:
    """Factors of an encoded content (``kind``, null for none) with the type found in it, and of what ``findings`` say is embedded."""
    some = lambda *prefixes: F.exists(findings, lambda f: _any_of(f.startswith(p) for p in prefixes))
    summary = lambda f: F.transform(F.split(F.lower(F.split_part(f, F.lit("="), F.lit(2))), ","), lambda e: F.trim(F.split_part(e, F.lit(":"), F.lit(1))))
    embedded = lambda types: F.exists(findings, lambda f: f.rlike("^(html|script):data-exts=") & F.exists(summary(f), lambda e: e.isin(types)))
    present, low = F.coalesce(kind != "", F.lit(False)), F.lower(inner)
    return F.array_compact(F.array(
        F.when(present, _factor("Encoded.Present", 10)), F.when(present & low.isin(PROGRAMS), _factor("Encoded.InnerExecutable", 20)), F.when(present & low.isin(SCRIPT_TYPES), _factor("Encoded.InnerScript", 15)),
        F.when(some("html:data-uri=", "html:data-b64=", "script:data-uri=", "script:data-b64="), _factor("Encoded.Embedded", 10)),
        F.when(embedded(PROGRAMS), _factor("Encoded.EmbeddedExecutable", 20)), F.when(embedded(SCRIPT_TYPES), _factor("Encoded.EmbeddedScript", 15)),
    ))


def _any_of(tests) -> Column:  # noqa: ANN001
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def signature_factors(extension: Column, subtype: Column, signature: Column | None = None) -> Column:
    """Factors of a signature's quality, or of its absence from what should have one.

    ``signature`` has booleans ``present, self_signed, chain_valid, envelope_valid, trusted, timestamped``, null where unknown.
    """
    expected = F.coalesce(F.lower(extension).isin(PROGRAMS), F.lit(False)) | F.coalesce(F.lower(subtype).isin(APP_PACKAGES), F.lit(False))
    if signature is None:
        return F.array_compact(F.array(F.when(expected, _factor("Sig.Absent", 10))))
    yes = lambda name: F.coalesce(signature[name], F.lit(False))
    no = lambda name: F.coalesce(~signature[name], F.lit(False))
    chain = ~yes("self_signed") & no("chain_valid")
    distrust = ~yes("self_signed") & ~chain & no("trusted")
    failed = yes("self_signed") | chain | no("envelope_valid") | distrust
    there = yes("present") | yes("trusted")
    return F.array_compact(F.array(
        F.when(there & yes("self_signed"), _factor("Sig.SelfSigned", 20)), F.when(there & chain, _factor("Sig.ChainInvalid", 25)), F.when(there & no("envelope_valid"), _factor("Sig.BadEnvelope", 15)),
        F.when(there & distrust, _factor("Sig.WinTrustInvalid", 25)), F.when(there & ~failed & no("timestamped"), _factor("Sig.NoTimestamp", 5)), F.when(~there & expected, _factor("Sig.Absent", 10)),
    ))


# Weights of a name's issues.
NAME_ISSUES = {"double_extension": ("Name.DoubleExtension", 15), "bidi": ("Name.BiDiOverride", 25), "mismatch": ("Name.ExtensionMismatch", 10)}


def name_factors(issues: Column) -> Column:
    """Factors of an array of a name's issues."""
    return F.array_compact(F.array(*(F.when(F.array_contains(issues, k), _factor(*v)) for k, v in NAME_ISSUES.items())))


def type_factors(extension: Column, confidence: Column, reason: Column, candidates: Column, mismatch: Column, guessed: Column | None = None, validation: Column | None = None) -> Column:
    """Factors of how sure the type is: a low confidence, several candidates, dangerous ones, a failed validation."""
    true = lambda c: F.coalesce(c, F.lit(False))
    low, by_name = true(confidence == "Low"), true(reason.startswith("extension:"))
    several, others = true(F.size(candidates) > 1), true(F.exists(F.slice(candidates, 2, 1000), lambda c: c["is_dangerous"]))
    guess = F.lit(False) if guessed is None else true((guessed != "") & (guessed != F.coalesce(extension, F.lit(""))) & is_dangerous(guessed))
    dangerous, off = is_dangerous(extension), true(mismatch)
    risky = dangerous | guess | others | off
    status = F.lit(None).cast("string") if validation is None else F.lower(validation)
    unsure = true((status != "") & ~status.isin("passed", "match")) & (risky | several)
    return F.array_compact(F.array(
        F.when(by_name & risky, _factor("Type.ExtensionOnlyRisk", 12)).when(low & risky, _factor("Type.LowConfidenceRisk", 10)), F.when(several & (risky | low), _factor("Type.AmbiguousCandidates", 8)),
        F.when(others, _factor("Type.DangerousAlternative", 12)), F.when(guess, _factor("Type.GuessedSubtypeRisk", 8)), F.when(off & dangerous, _factor("Type.DangerousMismatch", 30)),
        F.when(unsure & (status == "skipped"), _factor("Type.ValidationUncertain", 4)).when(unsure, _factor("Type.ValidationUncertain", 8)),
    ))


def package_factors(publisher: Column, is_installer: Column, signer: Column, findings: Column, capabilities: Column | None = None, extensions: Column | None = None, allowed: list[str] = ()) -> Column:
    """Factors of who made a package: known vendors lower the score; what an application's manifest asks for raises it.

    ``allowed``: vendors, any of which a name may contain, in any case.
    """
    named = F.coalesce(F.trim(publisher) != "", F.lit(False))
    known = lambda who: F.coalesce(_any_of(F.contains(F.lower(who), F.lit(v.lower())) for v in allowed if v), F.lit(False))
    said = lambda names, part: F.lit(False) if names is None else F.coalesce(F.exists(names, lambda n: F.contains(F.lower(n), F.lit(part))), F.lit(False))
    vendor = named & known(publisher)
    return F.array_compact(F.array(
        F.when(named, _factor("Package.VendorPresent", 0)).when(F.coalesce(is_installer, F.lit(False)), _factor("Package.VendorUnknown", 0)), F.when(vendor, _factor("Package.VendorAllowed", -15)),
        F.when(~vendor & known(signer), _factor("Sig.VendorAllowed", -10)), F.when(F.array_contains(findings, "pe:regsvr"), _factor("PE.RegSvrExport", 10)),
        F.when(said(capabilities, "runfulltrust"), _factor("Appx.Capability.RunFullTrust", 20)), F.when(said(capabilities, "broadfilesystemaccess"), _factor("Appx.Capability.BroadFileSystemAccess", 15)),
        F.when(said(extensions, "windows.protocol"), _factor("Appx.Extension.Protocol", 5)), F.when(said(extensions, "filetypeassociation"), _factor("Appx.Extension.FTA", 5)),
    ))


def volume_factors(counts: dict[str, Column], present: Column) -> Column:
    """Factors of counted secrets by code: the base where ``present`` (codes) lacks it, and one for those beyond the first."""
    base = {code: weight for code, weight in FINDINGS.values()}
    out = []
    for code, n in counts.items():
        each, most = VOLUMES[code]
        out += [F.when((n > 0) & ~F.array_contains(present, code), _factor(code, base[code])), F.when(n > 1, _factor(f"{code}.Volume", F.least(F.lit(most), (n - 1) * each)))]
    return F.array_compact(F.array(*out))


def score(factors: Column) -> Column:
    """The fold of the weights in order: a negative one never takes the running score below 0; at most 100 in the end."""
    fold = F.aggregate(factors, F.lit(0), lambda s, f: F.when(f["weight"] < 0, F.greatest(F.lit(0), s + f["weight"])).otherwise(s + f["weight"]))
    return F.least(F.lit(100), F.greatest(F.lit(0), fold))


def decision(score: Column, profile: str = "balanced") -> Column:
    warn = min(max(WARN + PROFILES[profile], 1), 99)
    block = min(max(BLOCK + PROFILES[profile], 2), 100)
    block = min(100, warn + 1) if block <= warn else block
    return F.when(score >= block, "Block").when(score >= warn, "Warn").otherwise("Allow")


def assess(factors: Column) -> Column:
    """``score, decision, decision_strict, decision_lenient, codes, factors`` of an array of factors."""
    s = score(factors)
    totals = F.map_from_entries(F.transform(F.array_distinct(F.transform(factors, lambda f: f["code"])), lambda c: F.struct(c, F.aggregate(F.filter(factors, lambda f: f["code"] == c), F.lit(0), lambda t, f: t + f["weight"]))))
    return F.struct(s.alias("score"), decision(s).alias("decision"), decision(s, "strict").alias("decision_strict"), decision(s, "lenient").alias("decision_lenient"), F.array_distinct(F.transform(factors, lambda f: f["code"])).alias("codes"), totals.alias("factors"))


def top_drivers(factors: Column, n: int = 3) -> Column:
    """The codes of the heaviest factors, by size, then by code."""
    ordered = F.array_sort(factors, lambda a, b: F.when(F.abs(a["weight"]) != F.abs(b["weight"]), F.abs(b["weight"]) - F.abs(a["weight"])).when(a["code"] < b["code"], -1).when(a["code"] > b["code"], 1).otherwise(0))
    return F.transform(F.slice(ordered, 1, n), lambda f: f["code"])
