"""Sort: seven orders, made definite by the place of a line among equal ones."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import semantics as S
from .frame import LineFrame

MODES = ("alpha", "alpha_desc", "shortest", "longest", "numeric", "numeric_desc", "natural")
# Fixed value: the greatest magnitude of a decimal number; beyond it a line counts as text.
GREATEST = "79228162514264337593543950335"
NUMBER = "^[\\t-\\r ]*[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?[\\t-\\r ]*$"


def number(value: Column) -> tuple[Column, Column]:
    """A line as a number, and its fraction to more places; null for text."""
    bare = F.when(value.rlike(NUMBER), F.regexp_replace(value, "[\\t-\\r ]", ""))
    whole = bare.try_cast("decimal(38,9)")
    whole = F.when(F.abs(whole) <= F.lit(GREATEST).cast("decimal(38,0)"), whole)
    return whole, F.when(whole.isNotNull(), bare.try_cast("decimal(38,28)"))


def natural(value: Column, case_sensitive: bool) -> Column:
    """Runs of digits by their number and others by their text; where the kinds differ, as '0' is to the text."""
    runs = F.regexp_extract_all(value, F.lit("([0-9]+|[^0-9]+)"), F.lit(1))

    def part(p: Column) -> Column:
        digits = p.rlike("^[0-9]")
        kind = F.when(digits, 1).when(F.substring(p, 1, 1) < "0", 0).otherwise(2)
        n = F.coalesce(F.when(digits, p.try_cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))
        long = digits & p.try_cast("decimal(38,0)").isNull()  # more than 38 digits: after all others, by text
        text = F.when(~digits, S.key(p, case_sensitive)).when(long, F.concat(F.lpad(F.length(p).cast("string"), 10, "0"), p)).otherwise("")
        return F.struct(kind.alias("kind"), long.alias("long"), n.alias("n"), text.alias("s"))

    return F.transform(runs, part)


@dataclass(frozen=True)
class Sort:
    mode: str = "alpha"
    case_sensitive: bool = False
    strict: bool = False

    def __post_init__(self):
        if self.mode not in MODES:
            raise ValueError(f"mode: {self.mode}")

    def keys(self, value: Column) -> list[tuple[Column, bool]]:
        """(key, ascending), the first counts most."""
        text = S.order_key(value, self.case_sensitive, self.strict)
        if self.mode in ("alpha", "alpha_desc"):
            return [(text, self.mode == "alpha")]
        if self.mode in ("shortest", "longest"):
            up = self.mode == "shortest"
            return [(S.len16(value), up), (text, up)]
        if self.mode == "natural":
            return [(natural(value, self.case_sensitive), True)]
        n, fraction = number(value)
        up = self.mode == "numeric"
        return [(n.isNull(), up), (n, up), (fraction, up), (F.when(n.isNull(), text), up)]

    def apply(self, frame: LineFrame) -> LineFrame:
        df, order = frame.df, []
        taken = set(df.columns)
        for key, up in self.keys(F.col("value")):
            name = f"sort_{len(order)}"
            while name in taken:
                name += "_"
            taken.add(name)
            df = df.withColumn(name, key)
            order.append((name, up))
        return LineFrame(df, (*order, *frame.order), costly=True)

    def counts(self, frame: LineFrame) -> DataFrame:
        return frame.df.agg(F.count("*").alias("input"), F.count("*").alias("output"), F.lit(0).cast("long").alias("affected"))
