"""The symbol row and its schema."""

from __future__ import annotations

from pyspark.sql import types as T

from symsearch.plans.fields import EnumField, ExactField, IntegerField, NameField, PathField, ReferencesField, Schema

# The ELF codes of symbol types and machines, and their names.
SYMBOL_TYPES = {0: "NOTYPE", 1: "OBJECT", 2: "FUNC", 3: "SECTION", 4: "FILE", 5: "COMMON", 6: "TLS", 7: "NUM", 8: "RELC", 9: "SRELC", 10: "LOOS", 12: "HIOS", 13: "LOPROC", 15: "HIPROC"}
TYPE_NAMES = ("NOTYPE", "OBJECT", "FUNC", "SECTION", "FILE", "COMMON", "TLS", "NUM", "RELC", "SRELC", "LOOS", "LOOS_PLUS_ONE", "HIOS", "LOPROC", "LOPROC_PLUS_ONE", "HIPROC")
MACHINES = {2: "SPARC", 3: "386", 4: "68K", 7: "860", 8: "MIPS", 15: "PARISC", 20: "PPC", 21: "PPC64", 22: "S390", 40: "ARM", 42: "SH", 43: "SPARCV9", 50: "IA_64", 62: "X86_64", 83: "AVR", 94: "XTENSA", 105: "MSP430", 164: "QDSP6", 183: "AARCH64", 189: "MICROBLAZE", 190: "CUDA", 224: "AMDGPU", 243: "RISCV", 247: "BPF", 258: "LOONGARCH"}

SYMBOL = T.StructType(
    [
        T.StructField("arch", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("demangled", T.StringType()),
        T.StructField("section", T.StringType()),
        T.StructField("address", T.LongType()),
        T.StructField("size", T.LongType()),
        T.StructField("type", T.StringType()),
        T.StructField("relocations", T.ArrayType(T.StringType())),
        T.StructField("mtime", T.LongType()),
    ]
)

SCHEMA = Schema(
    (
        EnumField("arch", "XARCH", values=("NONE", *dict.fromkeys(MACHINES.values()))),
        PathField("path", "XP"),
        PathField("source", "XSRC", optional=True),
        NameField("name", "XN"),
        NameField("demangled", "XD", optional=True),
        ExactField("fullname", "XFN", key=("name", "demangled"), optional=True),
        ExactField("section", "XSN"),
        IntegerField("address", unsigned=True),
        IntegerField("size", unsigned=True),
        EnumField("type", "XT", values=TYPE_NAMES),
        ReferencesField("relocations", "XR"),
        IntegerField("mtime"),
    )
)
DEFAULT_FIELDS = ("name", "demangled")
