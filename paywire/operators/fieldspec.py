"""Field definitions of ISO 8583 messages: the standard table, and specs that extend or replace it."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field

from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

# The fields of ISO 8583:1987 as number, type (n digits, a letters, s special, b bytes, z track and mixes),
# length (a number: fixed; ..n: two-digit length up to n; ...n: three-digit length up to n) and name.
STANDARD = """
1 b 8 Secondary Bitmap
2 n ..19 Primary Account Number
3 n 6 Processing Code
4 n 12 Amount, Transaction
5 n 12 Amount, Settlement
6 n 12 Amount, Cardholder Billing
7 n 10 Transmission Date & Time
8 n 8 Amount, Cardholder Billing Fee
9 n 8 Conversion Rate, Settlement
10 n 8 Conversion Rate, Cardholder Billing
11 n 6 Systems Trace Audit Number
12 n 6 Time, Local Transaction
13 n 4 Date, Local Transaction
14 n 4 Date, Expiration
15 n 4 Date, Settlement
16 n 4 Date, Conversion
17 n 4 Date, Capture
18 n 4 Merchant Type
19 n 3 Acquiring Institution Country Code
20 n 3 PAN Extended Country Code
21 n 3 Forwarding Institution Country Code
22 n 3 Point-of-Service Entry Mode
23 n 3 Card Sequence Number
24 n 3 Network International Identifier
25 n 2 Point-of-Service Condition Code
26 n 2 Point-of-Service Capture Code
27 n 1 Authorizing Identification Response Length
28 ans 9 Amount, Transaction Fee
29 ans 9 Amount, Settlement Fee
30 ans 9 Amount, Transaction Processing Fee
31 ans 9 Amount, Settlement Processing Fee
32 n ..11 Acquiring Institution Identification Code
33 n ..11 Forwarding Institution Identification Code
34 n ..28 Primary Account Number, Extended
35 z ..37 Track 2 Data
36 n ...104 Track 3 Data
37 ans 12 Retrieval Reference Number
38 ans 6 Authorization Identification Response
39 an 2 Response Code
40 ans 3 Service Restriction Code
41 ans 8 Card Acceptor Terminal Identification
42 ans 15 Card Acceptor Identification Code
43 ans 40 Card Acceptor Name/Location
44 an ..25 Additional Response Data
45 an ..76 Track 1 Data
46 an ...999 Additional Data - ISO
47 an ...999 Additional Data - National
48 an ...999 Additional Data - Private
49 an 3 Currency Code, Transaction
50 an 3 Currency Code, Settlement
51 an 3 Currency Code, Cardholder Billing
52 b 8 Personal Identification Number Data
53 n 16 Security Related Control Information
54 an ...120 Additional Amounts
55 ans ...999 Reserved ISO
56 ans ...999 Reserved ISO
57 ans ...999 Reserved National
58 ans ...999 Reserved National
59 ans ...999 Reserved National
60 ans ...999 Reserved National
61 ans ...999 Reserved Private
62 ans ...999 Reserved Private
63 ans ...999 Reserved Private
64 b 8 Message Authentication Code
65 b 8 Bitmap, Tertiary
66 n 1 Settlement Code
67 n 2 Extended Payment Code
68 n 3 Receiving Institution Country Code
69 n 3 Settlement Institution Country Code
70 n 3 Network Management Information Code
71 n 4 Message Number
72 n 4 Message Number, Last
73 n 6 Date, Action
74 n 10 Credits, Number
75 n 10 Credits, Reversal Number
76 n 10 Debits, Number
77 n 10 Debits, Reversal Number
78 n 10 Transfer, Number
79 n 10 Transfer, Reversal Number
80 n 10 Inquiries, Number
81 n 10 Authorizations, Number
82 n 12 Credits, Processing Fee Amount
83 n 12 Credits, Transaction Fee Amount
84 n 12 Debits, Processing Fee Amount
85 n 12 Debits, Transaction Fee Amount
86 n 16 Credits, Amount
87 n 16 Credits, Reversal Amount
88 n 16 Debits, Amount
89 n 16 Debits, Reversal Amount
90 n 42 Original Data Elements
91 an 1 File Update Code
92 an 2 File Security Code
93 an 5 Response Indicator
94 an 7 Service Indicator
95 an 42 Replacement Amounts
96 b 8 Message Security Code
97 ans 17 Amount, Net Settlement
98 ans 25 Payee
99 n ..11 Settlement Institution Identification Code
100 n ..11 Receiving Institution Identification Code
101 ans ..17 File Name
102 ans ..28 Account Identification 1
103 ans ..28 Account Identification 2
104 ans ...100 Transaction Description
128 b 8 Message Authentication Code 2
"""
RESERVED = range(105, 128)  # opaque bytes with a three-digit length up to 999
TYPES = ("n", "a", "s", "an", "as", "ns", "ans", "b", "z")
TYPE_NAMES = {"Numeric": "n", "Alpha": "a", "Special": "s", "AlphaNumeric": "an", "AlphaSpecial": "as", "NumericSpecial": "ns", "AlphaNumericSpecial": "ans", "Binary": "b", "Track": "z"}


@dataclass(frozen=True)
class Definition:
    """prefix: digits of the length prefix, 0 for fixed; size: the length or its maximum."""

    number: int
    kind: str
    prefix: int
    size: int
    name: str

    def __post_init__(self) -> None:
        if not 1 <= self.number <= 128:
            raise ValueError(f"field {self.number} is outside 1..128")
        if self.kind not in TYPES:
            raise ValueError(f"field {self.number}: unknown type {self.kind}")
        if self.size < 0 or self.prefix and self.size >= 10**self.prefix:
            raise ValueError(f"field {self.number}: {self.size} does not fit {self.prefix} digits")


def _standard() -> dict[int, Definition]:
    found = {}
    for line in STANDARD.strip().splitlines():
        number, kind, size, name = line.split(" ", 3)
        dots = size.count(".")
        found[int(number)] = Definition(int(number), kind, dots, int(size.strip(".")), name)
    return found | {n: Definition(n, "b", 3, 999, "Reserved") for n in RESERVED}


@dataclass(frozen=True)
class FieldSpec:
    name: str = "standard"
    fields: dict[int, Definition] = field(default_factory=_standard)

    @classmethod
    def extending(cls, name: str, own: list[Definition]) -> FieldSpec:
        """`own` over the standard table; of two definitions of a number the last counts."""
        return cls(name, _standard() | {d.number: d for d in own})

    @classmethod
    def closed(cls, name: str, own: list[Definition]) -> FieldSpec:
        """Only `own`: any other field is unknown when parsing and building."""
        return cls(name, {d.number: d for d in own})

    @classmethod
    def from_toml(cls, text: str) -> FieldSpec:
        """name, extends_builtin (default true), [[field]] number, type, length = {fixed | llvar | lllvar = n}, name."""
        raw = tomllib.loads(text)
        own = []
        for f in raw.get("field", []):
            kinds = f["length"]
            if len(kinds) != 1 or next(iter(kinds)) not in ("fixed", "llvar", "lllvar"):
                raise ValueError(f"field {f['number']}: length needs one of fixed, llvar, lllvar")
            how, size = next(iter(kinds.items()))
            kind = TYPE_NAMES.get(f["type"], f["type"])
            own.append(Definition(f["number"], kind, {"fixed": 0, "llvar": 2, "lllvar": 3}[how], size, f.get("name", "")))
        make = cls.extending if raw.get("extends_builtin", True) else cls.closed
        return make(raw.get("name", ""), own)

    def by_number(self) -> list[tuple[int, int, bool] | None]:
        """(prefix digits, size, numeric) by number, None where a field is unknown."""
        return [(d.prefix, d.size, d.kind == "n") if (d := self.fields.get(n)) else None for n in range(129)]

    def table(self, spark: SparkSession) -> DataFrame:
        """number, type, prefix, size, name: 128 rows at most, so a broadcast of it is bounded."""
        rows = [(d.number, d.kind, d.prefix, d.size, d.name) for d in sorted(self.fields.values(), key=lambda d: d.number)]
        return spark.createDataFrame(rows, "number int, type string, prefix int, size int, name string")


@dataclass
class SpecTable:
    """Many interface specs by id, for columns that name a spec in each row.

    They are sent to the executors once, packed as one array of 129 entries a spec; `MOST` bounds them (about
    10 KB each).
    """

    spark: SparkSession
    specs: dict[str, FieldSpec]
    MOST = 10_000

    def __post_init__(self) -> None:
        if len(self.specs) > self.MOST:
            raise ValueError(f"{len(self.specs)} specs; at most {self.MOST} are sent to every executor")

    @classmethod
    def of(cls, table: DataFrame) -> SpecTable:
        """From rows (spec, extends, number, type, prefix, size, name); extends: over the standard table, else closed.  A spec without fields has one row with number NULL.

        Of two rows for a number the one with the greater (prefix, size, type, name) counts; a wrong definition raises.
        """
        most = cls.MOST * 129
        found = table.select("spec", "extends", "number", "type", "prefix", "size", "name").limit(most + 1).collect()
        if len(found) > most:
            raise ValueError(f"over {most} field definitions")
        own: dict[str, list[Definition]] = {}
        extends: dict[str, bool] = {}
        for r in sorted(found, key=lambda r: (r["spec"], r["number"] or 0, r["prefix"] or 0, r["size"] or 0, r["type"] or "", r["name"] or "")):
            extends[r["spec"]] = r["extends"] if r["extends"] is not None else True
            fields = own.setdefault(r["spec"], [])
            if r["number"] is not None:
                fields.append(Definition(r["number"], TYPE_NAMES.get(r["type"], r["type"]), r["prefix"], r["size"], r["name"] or ""))
        return cls(table.sparkSession, {k: (FieldSpec.extending if extends[k] else FieldSpec.closed)(k, d) for k, d in own.items()})

    def shared(self) -> Broadcast:
        if not hasattr(self, "_shared"):
            self._shared = self.spark.sparkContext.broadcast({k: s.by_number() for k, s in self.specs.items()})
        return self._shared
