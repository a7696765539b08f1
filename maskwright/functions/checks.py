"""Checksums as Spark SQL expressions. All take a name or path of a digit string."""

from __future__ import annotations

from maskwright.functions import fixed


def ascii_digits(text: str) -> str:
    """Every decimal digit of any script as ``0``..``9``."""
    return (
        f"if({text} rlike r'[^\\x00-\\x7F]', translate({text}, '{fixed.DIGITS_FROM}', "
        f"'{fixed.DIGITS_TO}'), {text})"
    )


def digit_at(digits: str, position: int) -> str:
    """The digit at a 1-based position."""
    return f"(ascii(substr({digits}, {position}, 1)) - 48)"


def number_at(digits: str, position: int) -> str:
    """The two-digit number at a 1-based position."""
    return f"({digit_at(digits, position)} * 10 + {digit_at(digits, position + 1)})"


def _weighted(digits: str, weights: tuple[int, ...]) -> str:
    return "(" + " + ".join(f"{digit_at(digits, i)} * {w}" for i, w in enumerate(weights, start=1)) + ")"


def lv_ok(digits: str) -> str:
    """Day and month in range, and the Latvian check digit."""
    return (
        f"({number_at(digits, 1)} between 1 and 31 and {number_at(digits, 3)} between 1 and 12 and "
        f"pmod(pmod(1101 - {_weighted(digits, fixed.LV_WEIGHTS)}, 11), 10) = {digit_at(digits, 11)})"
    )


def lt_ee_ok(digits: str) -> str:
    """Century digit, month and day in range, and the two-pass check digit."""
    first = f"pmod({_weighted(digits, fixed.LT_EE_WEIGHTS)}, 11)"
    second = f"pmod({_weighted(digits, fixed.LT_EE_WEIGHTS_SECOND)}, 11)"
    check = f"case when {first} < 10 then {first} when {second} < 10 then {second} else 0 end"
    return (
        f"({digit_at(digits, 1)} between 1 and 6 and {number_at(digits, 4)} between 1 and 12 and "
        f"{number_at(digits, 6)} between 1 and 31 and {check} = {digit_at(digits, 11)})"
    )


def iban_ok(account: str) -> str:
    """Length at least 15 without spaces, and the number form is 1 modulo 97."""
    compact = f"replace({account}, ' ', '')"
    return (
        f"(length({compact}) >= {fixed.IBAN_MIN_LENGTH} and aggregate(split(concat(substr({compact}, 5), "
        f"left({compact}, 4)), ''), 0, (acc, ch) -> if(ascii(ch) < 58, pmod(acc * 10 + ascii(ch) - 48, 97), "
        "pmod(acc * 100 + ascii(ch) - 55, 97))) = 1)"
    )
