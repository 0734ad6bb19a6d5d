"""Row helpers of the ISO 8583 codec: one message at a time, called over Arrow batches."""

from __future__ import annotations

DIALECTS = ("hybrid", "ascii", "binary")  # in the order in which a message is tried


class Bad(Exception):
    """code, field and offset of what is wrong with a message."""

    def __init__(self, code: str, field: int | None = None, offset: int | None = None):
        super().__init__(code)
        self.error = {"code": code, "field": field, "offset": offset}


class Cursor:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int, field: int | None = None) -> bytes:
        part = self.data[self.at : self.at + n]
        if len(part) < n:
            raise Bad("InsufficientBytes", field, self.at)
        self.at += n
        return part

    def digits(self, n: int, code: str, field: int | None = None) -> str:
        """n ASCII digits."""
        at, part = self.at, self.take(n, field)
        if not part.isdigit():
            raise Bad(code, field, at)
        return part.decode()

    def packed(self, n: int, field: int | None = None, pad_code: str = "InvalidBcdNibble") -> str:
        """n digits in whole bytes; an odd count has a zero nibble in front."""
        at, text = self.at, self.take((n + 1) // 2, field).hex()
        if not text.isdecimal() and text:
            raise Bad("InvalidBcdNibble", field, at)
        if n % 2 and text[0] != "0":
            raise Bad(pad_code, field, at)
        return text[n % 2 :]

    def hex_digits(self, n: int) -> str:
        at, part = self.at, self.take(n)
        text = part.decode("latin-1")
        if any(c not in "0123456789abcdefABCDEF" for c in text):
            raise Bad("InvalidBitmapHex", None, at)
        return text


_SET = [[k for k in range(1, 9) if byte >> (8 - k) & 1] for byte in range(256)]  # places of the bits of a byte, from 1


def parse(data: bytes, dialect: str, table: list[tuple[int, int, bool] | None]) -> tuple[str, list[tuple[int, bytes]]]:
    """Type and (number, value) pairs; table[number] is (prefix digits, size, numeric) or None."""
    c, binary = Cursor(data), dialect == "binary"
    mti = c.packed(4) if binary else c.digits(4, "InvalidMti")
    half = (lambda: c.hex_digits(16)) if dialect == "ascii" else (lambda: c.take(8).hex())
    bitmap = half()
    if bitmap[0] in "89abcdefABCDEF":
        bitmap += half()
    found = []
    for number in (8 * i + k for i, byte in enumerate(bytes.fromhex(bitmap)) for k in _SET[byte]):
        if number == 1:
            continue
        if table[number] is None:
            raise Bad("UnknownField", number, c.at)
        prefix, size, numeric = table[number]
        n = size
        if prefix:
            n = int(c.packed(prefix, number, "InvalidLengthPrefix") if binary else c.digits(prefix, "InvalidLengthPrefix", number))
            if n > size:
                raise Bad("LengthExceedsMax", number, c.at)
        found.append((number, c.packed(n, number).encode() if binary and numeric else c.take(n, number)))
    if c.at != len(data):
        raise Bad("TrailingBytes", None, c.at)
    return mti, found


def sniff(data: bytes, table: list[tuple[int, int, bool] | None]) -> tuple[str, str, list[tuple[int, bytes]]]:
    """The first dialect that takes all bytes, or the error of the first.

    What is kept is the error, not the exception: kept in a local variable, that would be a cycle through this frame and,
    by the frames above, hold the whole batch.
    """
    first = None
    for dialect in DIALECTS:
        try:
            return (dialect, *parse(data, dialect, table))
        except Bad as bad:
            first = first or bad.error
    raise Bad(**first)


def build(mti: str | None, fields: dict[int | None, bytes | None], dialect: str, table: list[tuple[int, int, bool] | None]) -> bytes:
    """All is checked before a byte is made; a NULL number or value, such as from text that is no number or no hex, is an error like others."""
    if None in fields:
        raise Bad("InvalidFieldNumber")
    binary, numbers = dialect == "binary", sorted(fields)
    if mti is None or len(mti) != 4 or not (mti.isascii() and mti.isdigit()):
        raise Bad("InvalidMti")
    for number in numbers:
        if not 2 <= number <= 128:
            raise Bad("InvalidFieldNumber", number)
        if fields[number] is None:
            raise Bad("InvalidValue", number)
        n = len(fields[number])
        if table[number] is None:
            raise Bad("UnknownField", number)
        prefix, size, numeric = table[number]
        if not prefix and n != size:
            raise Bad("FixedLengthMismatch", number)
        if n > size:
            raise Bad("LengthExceedsMax", number)
        if binary and numeric and n and not fields[number].isdigit():
            raise Bad("InvalidBcdDigit", number)
    wide = bool(numbers) and numbers[-1] > 64
    last = 128 if wide else 64
    bits = sum(1 << (last - n) for n in numbers) | wide << 127
    bitmap = bits.to_bytes(last // 8, "big")
    packed = lambda digits: bytes.fromhex(digits if len(digits) % 2 == 0 else "0" + digits)
    out = [packed(mti) if binary else mti.encode(), bitmap.hex().upper().encode() if dialect == "ascii" else bitmap]
    for number in numbers:
        prefix, _, numeric = table[number]
        value = fields[number]
        if prefix:
            size = f"{len(value):0{prefix}d}"
            out.append(packed(size) if binary else size.encode())
        out.append(packed(value.decode()) if binary and numeric else value)
    return b"".join(out)
