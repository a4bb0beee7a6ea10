"""Genetic codes as a dimension: which triplet means which amino acid under which code."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, lru_cache
from itertools import product

from pyspark.sql import DataFrame, SparkSession

BASES = "ACGT"
CODONS = ["".join(x) for x in product(BASES, repeat=3)]

# Amino acids of the standard code, triplets in the order AAA, AAC, AAG, AAT, ACA, ... TTT; * is a stop.
STANDARD = "KNKNTTTTRSRSIIMIQHQHPPPPRRRRLLLLEDEDAAAAGGGGVVVV*Y*YSSSS*CWCLFLF"
# Number, name, transl_table, further aliases, and the triplets that differ from the standard code.
CODES = [
    (0, "Universal", 1, "standard default", ""),
    (1, "Vertebrate-mtDNA", 2, "vertebrate_mtdna", "AGA* AGG* ATAM TGAW"),
    (2, "Yeast-mtDNA", 3, "yeast_mtdna", "ATAM CTAT CTCT CTGT CTTT TGAW"),
    (3, "Mold-Protozoan-mtDNA", 4, "mold_protozoan_mtdna mold-mtdna", "TGAW"),
    (4, "Invertebrate-mtDNA", 5, "invertebrate_mtdna", "AGAS AGGS ATAM TGAW"),
    (5, "Ciliate-Nuclear", 6, "ciliate_nuclear ciliate", "TAAQ TAGQ"),
    (6, "Echinoderm-mtDNA", 9, "echinoderm_mtdna", "AAAN AGAS AGGS TGAW"),
    (7, "Euplotid-Nuclear", 10, "euplotid_nuclear euplotid", "TGAC"),
    (8, "Alt-Yeast-Nuclear", 12, "alt_yeast_nuclear", "CTGS"),
    (9, "Ascidian-mtDNA", 13, "ascidian_mtdna", "AGAG AGGG ATAM TGAW"),
    (10, "Flatworm-mtDNA", 14, "flatworm_mtdna", "AAAN AGAS AGGS TAAY TGAW"),
    (11, "Blepharisma-Nuclear", 15, "blepharisma_nuclear", "TAGQ"),
    (12, "Chlorophycean-mtDNA", 16, "chlorophycean_mtdna chlorophycean", "TAGL"),
    (13, "Trematode-mtDNA", 21, "trematode_mtdna trematode", "AAAN AGAS AGGS ATAM TGAW"),
    (14, "Scenedesmus-obliquus-mtDNA", 22, "scenedesmus_obliquus_mtdna scenedesmus-mtdna scenedesmus_mtdna", "TAGL TCA*"),
    (15, "Thraustochytrium-mtDNA", 23, "thraustochytrium_mtdna thraustochytrium", "TTA*"),
    (16, "Pterobranchia-mtDNA", 24, "pterobranchia_mtdna pterobranchia", "AGAS AGGK TGAW"),
    (17, "SR1-and-Gracilibacteria", 25, "sr1_and_gracilibacteria sr1 gracilibacteria", "TGAG"),
    (18, "Pachysolen-Nuclear", 26, "pachysolen_nuclear pachysolen", "CTGA"),
    (19, "Mesodinium-Nuclear", 29, "mesodinium_nuclear mesodinium", "TAAY TAGY"),
    (20, "Peritrich-Nuclear", 30, "peritrich_nuclear peritrich", "TAAE TAGE"),
    (21, "Cephalodiscidae-mtDNA", 33, "cephalodiscidae_mtdna cephalodiscidae", "AGAS AGGK TAAY TGAW"),
]
# Bases each IUPAC letter stands for.
IUPAC = {"A": "A", "C": "C", "G": "G", "T": "T", "U": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG"}


@dataclass(frozen=True)
class GeneticCode:
    number: int
    name: str
    amino: str

    @cached_property
    def sense(self) -> list[str]:
        """Triplets that are no stop, in order; a codon's state is its place here."""
        return [c for c, a in zip(CODONS, self.amino, strict=True) if a != "*"]

    @cached_property
    def state(self) -> dict[str, int]:
        return {c: k for k, c in enumerate(self.sense)}

    @cached_property
    def aa(self) -> list[str]:
        return [self.amino[CODONS.index(c)] for c in self.sense]

    @property
    def size(self) -> int:
        return len(self.sense)

    @cached_property
    def everything(self) -> int:
        return (1 << self.size) - 1

    def mask(self, triplet: str) -> int:
        """Bits of the sense codons a triplet may be; one that may be any, none or has a frame-shift mark may be all."""
        if len(triplet) != 3 or "!" in triplet:
            return self.everything
        options = product(*(IUPAC.get(c, BASES) for c in triplet.upper()))
        bits = 0
        for x in options:
            if (k := self.state.get("".join(x))) is not None:
                bits |= 1 << k
        return bits or self.everything

    def translate(self, seq: str) -> str:
        table = dict(zip(CODONS, self.amino, strict=True))
        return "".join(table.get(seq[k : k + 3], "X") for k in range(0, len(seq) - 2, 3))

    def pairs(self) -> list[tuple[int, int, int, bool]]:
        """(from, to, bases that differ, synonymous) for each ordered pair of different sense codons."""
        return [(i, j, sum(a != b for a, b in zip(x, y, strict=True)), self.aa[i] == self.aa[j]) for i, x in enumerate(self.sense) for j, y in enumerate(self.sense) if i != j]


@lru_cache(64)
def code(name: str | int = "Universal") -> GeneticCode:
    """A code by name, alias, `transl_table=N`, N of that, in any case."""
    wanted = str(name).strip().lower()
    for number, title, table, aliases, changes in CODES:
        if wanted in {title.lower(), f"transl_table={table}", str(table), *aliases.split()}:
            amino = list(STANDARD)
            for change in changes.split():
                amino[CODONS.index(change[:3])] = change[3]
            return GeneticCode(number, title, "".join(amino))
    raise ValueError(f"unknown genetic code: {name}")


def codes_table(spark: SparkSession) -> DataFrame:
    rows = [(n, title, [f"transl_table={t}", str(t), *aliases.split()]) for n, title, t, aliases, _ in CODES]
    return spark.createDataFrame(rows, "code_id int, name string, aliases array<string>")


def codon_table(spark: SparkSession, name: str | int = "Universal") -> DataFrame:
    """(codon, codon64, sense_idx, aa, is_stop): 64 rows."""
    c = code(name)
    return spark.createDataFrame([(x, k, c.state.get(x), a, a == "*") for k, (x, a) in enumerate(zip(CODONS, c.amino, strict=True))], "codon string, codon64 int, sense_idx int, aa string, is_stop boolean")


def pair_table(spark: SparkSession, name: str | int = "Universal") -> DataFrame:
    return spark.createDataFrame(code(name).pairs(), "i int, j int, num_diffs int, synonymous boolean")
