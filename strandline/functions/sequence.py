"""Column functions on sequences, coordinates and windows. Positions are 1-based, inclusive."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The 20 symbols and the padding symbol, in the order of all encodings.
ALPHABET = "ACDEFGHIKLMNPQRSTVWYX"
RESIDUES = ALPHABET[:20]

# fixed values: published physico-chemical scales
CHARGE = {"D": -1, "E": -1, "K": 1, "R": 1}
HYDROPHOBIC = "AILMFVWY"
#: Five published factors of each residue (Atchley et al. 2005).
ATCHLEY = {
    "A": (-0.591, -1.302, -0.733, 1.570, -0.146),
    "C": (-1.343, 0.465, -0.862, -1.020, -0.255),
    "D": (1.050, 0.302, -3.656, -0.259, -3.242),
    "E": (1.357, -1.453, 1.477, 0.113, -0.837),
    "F": (-1.006, -0.590, 1.891, -0.397, 0.412),
    "G": (-0.384, 1.652, 1.330, 1.045, 2.064),
    "H": (0.336, -0.417, -1.673, -1.474, -0.078),
    "I": (-1.239, -0.547, 2.131, 0.393, 0.816),
    "K": (1.831, -0.561, 0.533, -0.277, 1.648),
    "L": (-1.019, -0.987, -1.505, 1.266, -0.912),
    "M": (-0.663, -1.524, 2.219, -1.005, 1.212),
    "N": (0.945, 0.828, 1.299, -0.169, 0.933),
    "P": (0.189, 2.081, -1.628, 0.421, -1.392),
    "Q": (0.931, -0.179, -3.005, -0.503, -1.853),
    "R": (1.538, -0.055, 1.502, 0.440, 2.897),
    "S": (-0.228, 1.399, -4.760, 0.670, -2.647),
    "T": (-0.032, 0.326, 2.213, 0.908, 1.313),
    "V": (-1.337, -0.279, -0.544, 1.242, -1.262),
    "W": (-0.595, 0.009, 0.672, -2.128, -0.184),
    "Y": (0.260, 0.830, 3.097, -0.838, 1.512),
}
#: Ten published factors of each residue (Kidera et al. 1985).
KIDERA = {
    "A": (-1.56, -1.67, -0.97, -0.27, -0.93, -0.78, -0.20, -0.08, 0.21, -0.48),
    "C": (0.12, -0.89, 0.45, -1.05, -0.71, 2.41, 1.52, -0.69, 1.13, 1.10),
    "D": (0.58, -0.22, -1.58, 0.81, -0.92, 0.15, -1.52, 0.47, 0.76, 0.70),
    "E": (-1.45, 0.19, -1.61, 1.17, -1.31, 0.40, 0.04, 0.38, -0.35, -0.12),
    "F": (-0.21, 0.98, -0.36, -1.43, 0.22, -0.81, 0.67, 1.10, 1.71, -0.44),
    "G": (1.46, -1.96, -0.23, -0.16, 0.10, -0.11, 1.32, 2.36, -1.66, 0.46),
    "H": (-0.41, 0.52, -0.28, 0.28, 1.61, 1.01, -1.85, 0.47, 1.13, 1.63),
    "I": (-0.73, -0.16, 1.79, -0.77, -0.54, 0.03, -0.83, 0.51, 0.66, -1.78),
    "K": (-0.34, 0.82, -0.23, 1.70, 1.54, -1.62, 1.15, -0.08, -0.48, 0.60),
    "L": (-1.04, 0.00, -0.24, -1.10, -0.55, -2.05, 0.96, -0.76, 0.45, 0.93),
    "M": (-1.40, 0.18, -0.42, -0.73, 2.00, 1.52, 0.26, 0.11, -1.27, 0.27),
    "N": (1.14, -0.07, -0.12, 0.81, 0.18, 0.37, -0.09, 1.23, 1.10, -1.73),
    "P": (2.06, -0.33, -1.15, -0.75, 0.88, -0.45, 0.30, -2.30, 0.74, -0.28),
    "Q": (-0.47, 0.24, 0.07, 1.10, 1.10, 0.59, 0.84, -0.71, -0.03, -2.33),
    "R": (0.22, 1.27, 1.37, 1.87, -1.70, 0.46, 0.92, -0.39, 0.23, 0.93),
    "S": (0.81, -1.08, 0.16, 0.42, -0.21, -0.43, -1.89, -1.15, -0.97, -0.23),
    "T": (0.26, -0.70, 1.21, 0.63, -0.10, 0.21, 0.24, -1.15, -0.56, 0.19),
    "V": (-0.74, -0.71, 2.04, -0.40, 0.50, -0.81, -1.07, 0.06, -0.46, 0.65),
    "W": (0.30, 2.10, -0.72, -1.57, -1.16, 0.57, -0.48, -0.40, -2.30, -0.60),
    "Y": (1.38, 1.48, 0.80, -0.56, 0.00, -0.68, -0.31, 1.03, -0.05, 0.53),
}


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def at(seq: Column | str, start: Column | str, stop: Column | str) -> Column:
    """The span's text, null unless 1 <= start <= stop <= length."""
    seq, start, stop = c(seq), c(start), c(stop)
    return F.when((start >= 1) & (stop >= start) & (stop <= F.length(seq)), F.substring(seq, start, stop - start + 1))


def find_first(seq: Column | str, part: Column | str) -> Column:
    """Position of the first occurrence, null if there is none."""
    return F.nullif(F.instr(c(seq), c(part)), F.lit(0))


def find_all(seq: Column | str, part: Column | str) -> Column:
    """All positions, overlapping ones included, ascending."""
    seq, part = c(seq), c(part)
    last = F.length(seq) - F.length(part) + 1
    spots = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    # symbols as arrays, bound once: a substring at i would walk the text from its start each time
    both = F.array(F.struct(F.split(seq, "").alias("s"), F.split(part, "").alias("p"), F.length(part).alias("n"), spots.alias("at")))
    hits = F.transform(both, lambda b: F.filter(b["at"], lambda i: F.slice(b["s"], i, b["n"]) == b["p"]))
    return F.element_at(hits, 1)


def find_closest(seq: Column | str, part: Column | str, target: Column | str) -> Column:
    """The occurrence nearest to ``target``, the lower of equally near ones."""
    target = c(target)
    near = F.transform(find_all(seq, part), lambda i: F.struct(F.abs(i - target).alias("d"), i.alias("i")))
    return F.array_min(near).getField("i")


def left_flank(seq: Column | str, start: Column | str, size: int) -> Column:
    """P10: up to ``size`` symbols before the span, clipped at the terminus."""
    seq, start = c(seq), c(start)
    first = F.greatest(F.lit(1), start - size)
    return F.substring(seq, first, start - first)


def right_flank(seq: Column | str, stop: Column | str, size: int) -> Column:
    return F.substring(c(seq), c(stop) + 1, F.greatest(F.lit(0), F.least(F.lit(size), F.length(c(seq)) - c(stop))))


def pad_left(flank: Column | str, size: int) -> Column:
    return F.lpad(c(flank), size, "X")


def pad_right(flank: Column | str, size: int) -> Column:
    return F.rpad(c(flank), size, "X")


def context(seq: Column | str, start: Column | str, stop: Column | str, size: int) -> Column:
    """Padded window: flank, span, flank."""
    return F.concat(pad_left(left_flank(seq, start, size), size), F.substring(c(seq), c(start), c(stop) - c(start) + 1), pad_right(right_flank(seq, stop, size), size))


def positions(n_flank: Column | str, peptide: Column | str, c_flank: Column | str, flank: int, width: int = 9) -> list[Column]:
    """Columns N{flank}..N1, P1..P{width}, C1..C{flank}, null where a flank is shorter."""
    n, p, e = c(n_flank), c(peptide), c(c_flank)
    out = [F.when(F.length(n) >= i, F.substring(n, F.length(n) - i + 1, F.lit(1))).alias(f"N{i}") for i in range(flank, 0, -1)]
    out += [F.when(F.length(p) >= i, F.substring(p, i, 1)).alias(f"P{i}") for i in range(1, width + 1)]
    return out + [F.when(F.length(e) >= i, F.substring(e, i, 1)).alias(f"C{i}") for i in range(1, flank + 1)]


def position_names(flank: int, width: int = 9) -> list[str]:
    return [f"N{i}" for i in range(flank, 0, -1)] + [f"P{i}" for i in range(1, width + 1)] + [f"C{i}" for i in range(1, flank + 1)]


def pad_mask(start: Column | str, length: Column | str, flank: int, width: int) -> Column:
    """True for each slot of the window that lies outside the sequence."""
    first = c(start) - 1 - flank
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: (first + i < 0) | (first + i >= c(length)))


def kmers(seq: Column | str, shortest: int = 8, longest: int = 14) -> Column:
    """All substrings of the lengths as structs (kmer, start, stop)."""
    seq = c(seq)
    spots = F.when(F.length(seq) >= shortest, F.sequence(F.lit(1), F.length(seq) - shortest + 1)).otherwise(F.array().cast("array<int>"))
    each = F.transform(spots, lambda i: F.transform(F.sequence(F.lit(shortest), F.lit(longest)), lambda k: F.struct(F.substring(seq, i, k).alias("kmer"), i.alias("start"), (i + k - 1).alias("stop"))))
    return F.filter(F.flatten(each), lambda s: s.getField("stop") <= F.length(seq))


def chunks(length: Column | str, size: int = 1000, step: int = 900) -> Column:
    """0-based starts of overlapping chunks."""
    return F.sequence(F.lit(0), F.greatest(F.lit(0), c(length) - 1), F.lit(step))


def fraction(text: Column | str, symbol: str, width: int) -> Column:
    """P20: share of a symbol."""
    return (F.length(c(text)) - F.length(F.replace(c(text), F.lit(symbol), F.lit("")))) / F.lit(float(width))


def one_hot(symbol: Column | str, alphabet: str = ALPHABET) -> Column:
    """One number for each symbol of the alphabet; unknown or null: all 0."""
    return F.array(*[F.coalesce((c(symbol) == a).cast("int"), F.lit(0)) for a in alphabet])


def encode(symbol: Column | str, table: dict[str, tuple[float, ...]]) -> Column:
    """The row of a matrix for one symbol, zeros if null or unknown. Rows are found by the
    symbol's place in the matrix, without a search of a map."""
    width, names = len(next(iter(table.values()))), "".join(table)
    rows = F.array(F.array(*[F.lit(0.0)] * width), *[F.array(*[F.lit(float(y)) for y in v]) for v in table.values()])
    place = F.when(F.length(c(symbol)) == 1, F.instr(F.lit(names), c(symbol))).otherwise(0)
    return F.element_at(rows, F.coalesce(place, F.lit(0)) + 1)


def encode_all(symbols: Column | str, table: dict[str, tuple[float, ...]]) -> Column:
    """The rows of a matrix for an array of symbols, one after the other in one array."""
    return F.flatten(F.transform(c(symbols), lambda s: encode(s, table)))


def one_hot_table(alphabet: str = ALPHABET) -> dict[str, tuple[float, ...]]:
    """P18 as a matrix for ``encode_all``: the identity."""
    return {a: tuple(float(a == b) for b in alphabet) for a in alphabet}


def net_charge(peptide: Column | str) -> Column:
    """P22, null for null or empty text."""
    count = lambda a: F.length(c(peptide)) - F.length(F.replace(c(peptide), F.lit(a), F.lit("")))
    total = sum((count(a) * v for a, v in CHARGE.items()), F.lit(0))
    return F.when(F.length(c(peptide)) > 0, total)


def hydrophobic_share(peptide: Column | str) -> Column:
    hit = F.length(F.regexp_replace(c(peptide), f"[^{HYDROPHOBIC}]", ""))
    return F.when(F.length(c(peptide)) > 0, hit / F.length(c(peptide)).cast("double"))


def lanes(text: Column | str, length: int) -> list[Column]:
    """A string of ``length`` symbols as numbers: three code points of 21 bits each in a long."""
    point = lambda i: F.ascii(F.substring(c(text), i + 1, 1)).cast("long")
    out = []
    for at in range(0, length, 3):
        word = point(at)
        for k in range(1, min(3, length - at)):
            word = word.bitwiseOR(F.shiftleft(point(at + k), 21 * k))
        out.append(word)
    return out


def lane_distance(a: list[Column], b: list[Column]) -> Column:
    """Number of differing places of two strings given as ``lanes``."""
    low, high = (sum(m << 21 * k for k in range(3)) for m in ((1 << 20) - 1, 1 << 20))
    total = F.lit(0)
    for x, y in zip(a, b):
        differs = x.bitwiseXOR(y)
        # adding all ones below a lane's highest bit carries into it unless the lane is 0
        marked = (differs.bitwiseAND(F.lit(low)) + F.lit(low)).bitwiseOR(differs)
        total = total + F.bit_count(marked.bitwiseAND(F.lit(high)))
    return total.cast("int")
