"""Facts of Windows executables, read by offsets within the content: expressions alone, no walk outside the engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Machines and subsystems by number.
MACHINES = {0x14C: "x86", 0x8664: "x64", 0x1C0: "arm", 0xAA64: "arm64", 0x200: "ia64"}
SUBSYSTEMS = {1: "native", 2: "gui", 3: "console", 9: "wince", 10: "efi", 11: "efi-boot", 12: "efi-runtime", 14: "xbox"}


def little_endian(content: Column, offset: Column, size: int) -> Column:
    """An unsigned number at a byte offset, null beyond the end."""
    raw = content.substr(offset.cast("int") + 1, F.lit(size))
    digits = F.hex(raw)
    turned = F.concat(*(F.substring(digits, 2 * i + 1, 2) for i in reversed(range(size))))
    return F.when(F.octet_length(raw) == size, F.conv(turned, 16, 10).cast("long"))


def portable_facts(content: Column) -> Column:
    """Machine, subsystem, type and hardening of an executable; null where the content is none."""
    at = little_endian(content, F.lit(0x3C), 4)
    safe = F.when((at > 0) & (at < F.octet_length(content) - 24), at)
    is_pe = F.coalesce((F.hex(F.substring(content, 1, 2)) == "4D5A") & (F.hex(content.substr(safe.cast("int") + 1, F.lit(4))) == "50450000"), F.lit(False))
    u = lambda o, n: little_endian(content, safe + o, n)
    wide = u(24, 2) == 0x20B
    pick = lambda table, x: F.coalesce(*(F.when(x == k, F.lit(v)) for k, v in table.items()))
    characteristics, subsystem, dll = u(22, 2), u(24 + 68, 2), u(24 + 70, 2)
    directory = lambda i: F.when(wide, u(24 + 112 + 8 * i, 4)).otherwise(u(24 + 96 + 8 * i, 4))
    bit = lambda x, b: x.bitwiseAND(b) != 0
    head = F.decode(F.substring(content, 1, 4096), "iso-8859-1")
    flags = F.array_compact(F.array(
        F.when(F.contains(head, F.lit("UPX0")) | F.contains(head, F.lit("UPX!")), F.lit("pe_packed")), F.when(~bit(dll, 0x40), F.lit("pe_no_aslr")), F.when(~bit(dll, 0x100), F.lit("pe_no_nx")), F.when(~bit(dll, 0x4000), F.lit("pe_no_cfg")),
    ))
    ext = F.when(bit(characteristics, 0x2000), "dll").when(subsystem == 1, "sys").otherwise("exe")
    return F.when(is_pe, F.struct(pick(MACHINES, u(4, 2)).alias("machine"), pick(SUBSYSTEMS, subsystem).alias("subsystem"), ext.alias("extension"), (directory(14) > 0).alias("is_dotnet"), (directory(4) > 0).alias("has_signature"), u(6, 2).alias("sections"), flags.alias("flags")))
