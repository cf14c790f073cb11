"""How numbers, names and files are shown, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Glyphs, colours and descriptions.
GLYPHS = {"api-route": "◆", "route": "▪", "component": "●", "layout": "◻", "middleware": "◈", "schema": "⬡", "test": "▲", "config": "⚙"}
OTHER_GLYPH = "○"
TYPE_COLOURS = {"route": "#FF6B35", "api-route": "#E63946", "component": "#457B9D", "layout": "#A8DADC", "middleware": "#F4A261", "schema": "#2A9D8F", "test": "#6C757D", "config": "#ADB5BD", "utility": "#264653", "module": "#E9ECEF"}
COMPLEXITY_COLOURS = ("#2D6A4F", "#52B788", "#B5E48C", "#FED766", "#F4845F", "#E63946")
DESCRIPTIONS = (("app", "routes, pages, admin, TLC"), ("test", "unit, api, integration"), ("lib", "auth, payment, POS, email"), ("component", "TLC, admin, kitchen, shared"), ("script", "deploy, sync, broadcast"), ("cluster", "POS API client"), ("prisma", "schema, migrations"), ("data", "menu-pricing"), ("e2e", "end-to-end tests"))


def fixed(x: Column, digits: int) -> Column:
    """A number from 0 on with so many digits; halves of the binary value go up.

    The product's rounding error is known exactly, so that 1.15, which is a little less, gives 1.1.
    """
    scale = float(10**digits)
    product = x * scale
    high = x * 134217729.0 - (x * 134217729.0 - x)
    error = (high * scale - product) + (x - high) * scale
    whole = F.floor(product)
    part = product - whole
    n = (whole + F.when((part > 0.5) | ((part == 0.5) & (error >= 0)), 1).otherwise(0)).cast("long")
    if not digits:
        return n.cast("string")
    return F.concat(F.floor(n / scale).cast("long").cast("string"), F.lit("."), F.lpad(F.pmod(n, F.lit(10**digits)).cast("string"), digits, "0"))


def plain_number(x: Column) -> Column:
    """A number as short as it can be: whole ones without a point."""
    return F.when(x == F.floor(x), x.cast("long").cast("string")).otherwise(x.cast("string"))


def grouped(n: Column) -> Column:
    """With commas between thousands."""
    return F.format_number(n, 0)


def padded(text: Column, width: int, before: bool = False) -> Column:
    """Spaces after (or before) the text up to the width; longer texts stay whole."""
    fill = F.repeat(F.lit(" "), F.greatest(F.lit(0), width - F.length(text)))
    return F.concat(fill, text) if before else F.concat(text, fill)


def capitalized(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 1 << 30))


def some(items: Column, most: int) -> Column:
    """The first of an array's strings, with how many more there are."""
    more = F.size(items) - most
    return F.concat(F.array_join(F.slice(items, 1, most), ", "), F.when(more > 0, F.concat(F.lit(", +"), more.cast("string"), F.lit(" more"))).otherwise(""))


def complexity_bar(x: Column, width: int = 10) -> Column:
    """A block for each tenth, darkest up to half of the value, lightest above three quarters of it; dots beyond."""
    full = F.floor(x * width + 0.5)
    block = lambda i: F.when(i > full, "·").when(i / width <= x * 0.5, "█").when(i / width <= x * 0.75, "▓").otherwise("░")
    return F.array_join(F.transform(F.sequence(F.lit(1), F.lit(width)), block), "")


def described(path: Column) -> Column:
    """What a module is, by the first word of DESCRIPTIONS in its path; empty where none is."""
    out = F.lit("")
    for word, text in reversed(DESCRIPTIONS):
        out = F.when(F.contains(F.lower(path), F.lit(word)), text).otherwise(out)
    return out


def _of(table: dict[str, str], kind: Column, other: str) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[kind], F.lit(other))


def glyph(kind: Column) -> Column:
    return _of(GLYPHS, kind, OTHER_GLYPH)


def type_colour(kind: Column) -> Column:
    return _of(TYPE_COLOURS, kind, TYPE_COLOURS["utility"])


def xml_escaped(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def _part(colour: Column, i: int) -> Column:
    return F.conv(F.substring(F.replace(colour, F.lit("#"), F.lit("")), 1 + 2 * i, 2), 16, 10).cast("double")


def blended(a: Column, b: Column, share: Column) -> Column:
    """rgb(...) at a share of the way from one #rrggbb to another."""
    parts = [F.floor(_part(a, i) + (_part(b, i) - _part(a, i)) * share + 0.5).cast("string") for i in range(3)]
    return F.concat(F.lit("rgb("), F.concat_ws(",", *parts), F.lit(")"))


def complexity_colour(x: Column) -> Column:
    """On the way through COMPLEXITY_COLOURS, for 0 to 1."""
    steps = len(COMPLEXITY_COLOURS) - 1
    at = F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)) * steps
    step = F.least(F.floor(at), F.lit(steps - 1)).cast("int")
    colours = F.array(*map(F.lit, COMPLEXITY_COLOURS))
    return blended(F.get(colours, step), F.get(colours, step + 1), at - step)
