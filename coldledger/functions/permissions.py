"""POSIX mode bits as boolean expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def has_bits(mode: Column, bits: int) -> Column:
    return mode.bitwiseAND(F.lit(bits)) == F.lit(bits)


# A class's three bits start at its shift; a mode is open to everybody if all classes have these bits.
_CLASSES = {"owner": 6, "group": 3}
_BIT = {"read": 4, "write": 2}
_OPEN = {"read": 0o444, "write": 0o666}


def mode_flags(mode: Column, owner: Column, group: Column, uid: int,
               gids: Sequence[int]) -> dict[str, Column]:
    """Named flags for one user: ownership, single bits, and the resulting access."""
    holds = {"owner": owner == F.lit(uid), "group": group.isin([int(g) for g in gids]) if gids else F.lit(False)}
    flags = {"is_owner": holds["owner"], "is_group_member": holds["group"]}
    for access, everybody in (("read", "is_444"), ("write", "is_666_or_777")):
        flags[everybody] = has_bits(mode, _OPEN[access])
        granted = flags[everybody]
        for who, shift in _CLASSES.items():
            flags[f"{who}_{access}"] = has_bits(mode, _BIT[access] << shift)
            granted = granted | holds[who] & flags[f"{who}_{access}"]
        flags[f"can_{access}"] = granted
    return flags


def can_search(mode: Column, owner: Column, group: Column, uid: int, gids: Sequence[int]) -> Column:
    """May the user pass through a directory? By the bit of the first class that the user belongs to."""
    member = group.isin([int(g) for g in gids]) if gids else F.lit(False)
    return F.when(owner == F.lit(uid), has_bits(mode, 0o100)).when(member, has_bits(mode, 0o010)).otherwise(has_bits(mode, 0o001))


def entry_type(mode: Column) -> Column:
    """'d' for a directory, 'l' for a link, 'f' for anything else, from the file-type bits."""
    kind = mode.bitwiseAND(F.lit(0o170000))
    return F.when(kind == 0o040000, F.lit("d")).when(kind == 0o120000, F.lit("l")).otherwise(F.lit("f"))
