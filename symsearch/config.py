"""Settings from a TOML file."""

from __future__ import annotations

import logging
import os
import tomllib
from dataclasses import asdict, dataclass, field

from symsearch.plans.symbols import MACHINES

log = logging.getLogger("symsearch")

# Fixed value: how a symbol's code is shown by default.
DISASSEMBLER_ARGS = "-dC --no-show-raw-insn '{path}' --section '{section}' --start-address 0x{address:x} --stop-address 0x{endaddress:x}"


@dataclass
class Indexing:
    """What an index run does; lists are added to those of the command line."""

    demangle_names: bool = True
    index_relocations: bool = False
    min_symbol_size: int = 1
    use_dwarfdump: bool = True
    exclude: list[str] = field(default_factory=list)
    extra_globs: list[str] = field(default_factory=list)


@dataclass
class Tools:
    """Programs for one kind of machine."""

    addr2line: str = "addr2line"
    dwarfdump: str = "dwarfdump"
    disassembler: str = "objdump"
    disassembler_args: str = DISASSEMBLER_ARGS


def _set(target: object, data: dict, where: str) -> None:
    known = target.__dataclass_fields__
    for key, value in data.items():
        name = key.replace("-", "_")
        if name not in known:
            log.warning("unknown key %r in %s", key, where)
            continue
        kind = type(getattr(target, name))
        if not isinstance(value, kind) or kind is int and isinstance(value, bool):
            raise TypeError(f"{key!r} in {where} is not of the type {kind.__name__}: {value!r}")
        if kind is list and not all(isinstance(x, str) for x in value):
            raise TypeError(f"{key!r} in {where} must hold texts: {value!r}")
        setattr(target, name, list(value) if kind is list else value)


def _merged(shared: dict, own: dict) -> dict:
    """``own`` over ``shared``, table by table."""
    return {**shared, **{k: _merged(shared.get(k, {}), v) if isinstance(v, dict) else v for k, v in own.items()}}


@dataclass
class Config:
    indexing: Indexing = field(default_factory=Indexing)
    tools: dict[str, Tools] = field(default_factory=dict)  #: by machine; ``default`` for the others
    directories: dict[str, Config] = field(default_factory=dict)

    @classmethod
    def of(cls, data: dict, where: str = "config") -> Config:
        out = cls()
        for key, value in data.items():
            if key == "indexing":
                _set(out.indexing, value, f"{where}: indexing")
            elif key in ("arch", "tools"):
                default = Tools()
                _set(default, value.get("default", {}), f"{where}: {key}.default")
                out.tools["default"] = default
                for machine, own in value.items():
                    if machine != "default":
                        if machine not in (known := ("NONE", *MACHINES.values())):
                            raise ValueError(f"{machine!r} in {where}: {key} is no kind of machine; these are: {', '.join(sorted(set(known)))}")
                        _set(tools := Tools(**asdict(default)), own, f"{where}: {key}.{machine}")
                        out.tools[machine] = tools
            elif key in ("path", "directory"):
                shared = {k: v for k, v in data.items() if k not in ("path", "directory")}
                for path, own in value.items():
                    out.directories[os.path.realpath(os.path.expanduser(path))] = cls.of(_merged(shared, own), f"{where}: {path}")
            else:
                log.warning("unknown key %r in %s", key, where)
        return out

    def for_directory(self, path: str) -> Config:
        return self.directories.get(os.path.realpath(path), self)

    def for_machine(self, arch: str) -> Tools:
        return self.tools.get(arch) or self.tools.get("default") or Tools()

    def to_toml(self) -> str:
        def value(v: object) -> str:
            if isinstance(v, bool):
                return str(v).lower()
            return "[" + ", ".join(map(value, v)) + "]" if isinstance(v, list) else str(v) if isinstance(v, int) else '"' + str(v).replace("\\", "\\\\").replace('"', '\\"') + '"'

        out = ["[indexing]", *(f"{k.replace('_', '-')} = {value(v)}" for k, v in asdict(self.indexing).items())]
        for machine, tools in (self.tools or {"default": Tools()}).items():
            out += ["", f"[arch.{machine}]", *(f"{k.replace('_', '-')} = {value(v)}" for k, v in asdict(tools).items())]
        return "\n".join(out) + "\n"


def default_path() -> str:
    base = os.environ.get("XDG_CONFIG_HOME") or os.path.expanduser("~/.config")
    return os.path.join(base, "symsearch", "config.toml")


def load(path: str | None = None) -> Config:
    """The config in a file; all defaults if the file isn't there."""
    path = path or default_path()
    if not os.path.isfile(path):
        return Config()
    with open(path, "rb") as f:
        return Config.of(tomllib.load(f), path)
