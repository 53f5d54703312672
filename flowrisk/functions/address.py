"""IP addresses as built-in expressions: canonical text, fixed-width digits and bits, networks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_GROUPS = "([0-9a-f]{1,4}(:[0-9a-f]{1,4})*)?"
_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def is_ipv4(value) -> Column:
    return _col(value).rlike(rf"^{_OCTET}(\.{_OCTET}){{3}}$")


def ipv4_number(value) -> Column:
    """The address as BIGINT, NULL for anything else."""
    part = F.split(_col(value), r"\.")
    octets = [F.try_element_at(part, F.lit(i + 1)).try_cast("bigint") * F.lit(256 ** (3 - i)) for i in range(4)]
    return F.when(is_ipv4(value), octets[0] + octets[1] + octets[2] + octets[3])


def ipv4_from_number(number) -> Column:
    """Dotted text of a BIGINT."""
    return F.concat_ws(".", *[F.shiftright(_col(number), s).bitwiseAND(255).cast("string") for s in (24, 16, 8, 0)])


def _padded(groups: Column) -> Column:
    """Hexadecimal groups between colons as four digits each, one after the other."""
    long = F.regexp_replace(F.concat(F.lit(":"), groups), ":", ":000")
    return F.when(groups == "", "").otherwise(F.regexp_replace(long, ":[0-9a-f]*([0-9a-f]{4})(?=:|$)", "$1"))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ipv6_hex(value) -> Column:
    """The 32 hexadecimal digits of an IPv6 address, a zone (``%eth0``) left out; NULL for anything else."""
    text = _col(value)
    zone = ~text.contains("%") | text.rlike("^[^%]+%[^%]+$")

    def six(address: Column) -> Column:
        """The address with a dotted tail as two groups."""
        tail = F.substring_index(address, ":", -1)
        head = address.substr(F.lit(1), F.length(address) - F.length(tail))
        low = lambda four: F.lpad(F.lower(F.hex(four)), 8, "0")
        joined = let(low(ipv4_number(tail)), lambda t: F.concat(head, F.substring(t, 1, 4), F.lit(":"), F.substring(t, 5, 4)))
        return F.when(address.contains("."), joined).otherwise(address)

    def halves(address: Column) -> Column:
        gap = address.contains("::")
        first = F.substring_index(address, "::", 1)
        last = F.when(gap, address.substr(F.length(first) + 3, F.length(address))).otherwise("")
        return let(F.struct(first.alias("first"), last.alias("last"), gap.alias("gap")), digits)

    def digits(half: Column) -> Column:
        shaped = half["first"].rlike(f"^{_GROUPS}$") & half["last"].rlike(f"^{_GROUPS}$")
        padded = F.struct(_padded(half["first"]).alias("head"), _padded(half["last"]).alias("end"))

        def filled(both: Column) -> Column:
            held = F.length(both["head"]) + F.length(both["end"])
            fits = F.when(half["gap"], held <= 28).otherwise(held == 32)
            return F.when(fits, F.concat(both["head"], F.repeat(F.lit("0"), 32 - held), both["end"]))

        return F.when(shaped, let(padded, filled))

    address = F.lower(F.substring_index(text, "%", 1))
    return F.when(text.contains(":") & zone, let(let(address, six), halves))


def ipv6_from_hex(digits) -> Column:
    """Canonical text of 32 hexadecimal digits: the first longest run of zero groups becomes ``::``."""
    digits = _col(digits)

    def shortened(groups: Column) -> Column:
        # Runs are texts of one kind, so the longest is the largest.
        run = F.coalesce(F.array_max(F.regexp_extract_all(groups, F.lit("(?::0)+(?=:|$)"), F.lit(0))), F.lit(""))
        return let(run, lambda run: F.when(F.length(run) < 4, groups.substr(F.lit(2), F.lit(40))).otherwise(let(
            F.instr(groups, run), lambda at: F.concat(groups.substr(F.lit(2), F.greatest(at - 2, F.lit(0))), F.lit("::"),
                                                      groups.substr(at + F.length(run) + 1, F.lit(40))))))

    groups = F.regexp_replace(F.regexp_replace(digits, "(.{4})", ":$1"), ":0{1,3}(?=[0-9a-f])", ":")
    mapped = F.concat(F.lit("::ffff:"), ipv4_from_number(F.conv(F.substring(digits, 25, 8), 16, 10).cast("bigint")))
    return F.when(digits.startswith("0" * 20 + "ffff"), mapped).otherwise(let(groups, shortened))


def address_text(value) -> Column:
    """Canonical text of an IPv4 or IPv6 address, with its zone; NULL for anything else."""
    text = _col(value)
    zone = F.when(text.contains("%"), F.concat(F.lit("%"), F.substring_index(text, "%", -1))).otherwise("")
    six = F.concat(let(ipv6_hex(text), ipv6_from_hex), zone)
    return F.when(is_ipv4(text), text).when(text.contains(":"), six)


def address_bits(value) -> Column:
    """The address as text of 32 or 128 binary digits; NULL for anything else."""
    text = _col(value)
    return (F.when(is_ipv4(text), F.lpad(F.bin(ipv4_number(text)), 32, "0"))
            .when(text.contains(":"), let(ipv6_hex(text), hex_bits)))


def hex_bits(digits) -> Column:
    """The 128 binary digits of 32 hexadecimal ones."""
    digits = _col(digits)
    return F.concat(*[F.lpad(F.conv(F.substring(digits, at, 16), 16, 2), 64, "0") for at in (1, 17)])


def bits_hex(bits) -> Column:
    """Binary digits, a multiple of 32, as a quarter as many hexadecimal ones."""
    bits = _col(bits)
    parts = [F.lpad(F.lower(F.conv(F.substring(bits, 32 * i + 1, 32), 2, 16)), 8, "0") for i in range(4)]
    return F.when(F.length(bits) == 32, parts[0]).otherwise(F.concat(*parts))
