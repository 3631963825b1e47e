"""Settings: JSON with typed getters, merging with a fallback, resources found along a search path, and an engine's parts."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field
from importlib import import_module
from typing import Any

from ..operators import oov, paths
from ..operators.text import CharTable, Normalize, Prolonged, Yomigana
from ..sources import binary, definitions, lexicon
from .dictionary import Dictionary, Lookup

#: Settings whose entries are plugins: objects with a name under "class".
PLUGINS = ("editConnectionCostPlugin", "inputTextPlugin", "oovProviderPlugin", "pathRewritePlugin")


def _remote(path: str) -> bool:
    return "://" in path


def _hadoop(path: str):
    """(path, file system) of a URI, by the running session."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    if spark is None:
        raise ValueError(f"{path} is read by a Spark session, and none is running")
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), spark


def exists(path: str) -> bool:
    """Whether a file or folder exists, on this machine or at a URI that Spark can reach."""
    if not _remote(path):
        return os.path.exists(path)
    p, system, _ = _hadoop(path)
    return system.exists(p)


def read_bytes(path: str) -> bytes:
    """A file's content, on this machine or at a URI that Spark can reach."""
    if not _remote(path):
        with open(path, "rb") as f:
            return f.read()
    return bytes(_hadoop(path)[2].read.format("binaryFile").load(path).select("content").first()[0])


def is_file(path: str) -> bool:
    if not _remote(path):
        return os.path.isfile(path)
    p, system, _ = _hadoop(path)
    return system.exists(p) and system.getFileStatus(p).isFile()


@dataclass
class Anchor:
    """Folders in which resources are looked up in turn, here or at URIs; an absolute path or a URI stands for itself."""

    folders: list[str] = field(default_factory=list)

    def resolve(self, path: str) -> str:
        """The first folder's file that exists, else the path in the last folder."""
        if os.path.isabs(path) or _remote(path):
            return path
        found = [os.path.join(f, path) for f in self.folders]
        return next((f for f in found if exists(f)), found[-1] if found else path)

    def exists(self, path: str) -> bool:
        return exists(self.resolve(path))

    def then(self, other: Anchor) -> Anchor:
        return Anchor([*self.folders, *(f for f in other.folders if f not in self.folders)])

    def text(self, path: str) -> str:
        return read_bytes(self.resolve(path)).decode("utf-8")


class Settings:
    """A JSON object with typed getters: a missing number is 0, a missing string None, a missing list empty, unless told."""

    def __init__(self, values: dict[str, Any] | None = None, anchor: Anchor | None = None):
        self.values, self.anchor = dict(values or {}), anchor or Anchor()

    @classmethod
    def parse(cls, text: str, anchor: Anchor | None = None) -> Settings:
        try:
            values = json.loads(text)
        except json.JSONDecodeError as e:
            raise ValueError(f"settings are no JSON: {e}") from e
        if not isinstance(values, dict):
            raise ValueError("settings are no object")
        anchor = anchor or Anchor()
        if isinstance(values.get("path"), str):
            anchor = Anchor([values["path"]]).then(anchor)
        return cls(values, anchor)

    @classmethod
    def from_file(cls, path: str, anchor: Anchor | None = None) -> Settings:
        folder = path.rsplit("/", 1)[0] if _remote(path) else os.path.dirname(os.path.abspath(path))
        return cls.parse(read_bytes(path).decode("utf-8"), Anchor([folder]).then(anchor or Anchor()))

    # Settings made in steps: each gives new settings and leaves these as they are.

    def but(self, **values) -> Settings:
        """These with other values; None takes one away."""
        return Settings({k: v for k, v in {**self.values, **values}.items() if v is not None}, self.anchor)

    def system_dictionary(self, path: str) -> Settings:
        return self.but(systemDict=path)

    def add_user_dictionary(self, path: str) -> Settings:
        return self.but(userDict=[*self.strings("userDict"), path])

    def clear_user_dictionaries(self) -> Settings:
        return self.but(userDict=[])

    def character_definition(self, path: str) -> Settings:
        return self.but(characterDefinitionFile=path)

    def allow_empty_morpheme(self, allow: bool = True) -> Settings:
        return self.but(allowEmptyMorpheme=allow)

    def add_plugin(self, kind: str, name: str, **values) -> Settings:
        """These with a further plugin of a kind (one of PLUGINS), behind those that there are."""
        if kind not in PLUGINS:
            raise ValueError(f"no kind of plugins: {kind}")
        return self.but(**{kind: [*(p.values for p in self.plugins(kind)), {"class": name, **values}]})

    def clear_plugins(self, kind: str) -> Settings:
        return self.but(**{kind: []})

    def with_anchor(self, anchor: Anchor) -> Settings:
        """These, looking for files along a path before their own."""
        return Settings(self.values, anchor.then(self.anchor))

    def _get(self, name: str, kind: type | tuple, default):
        x = self.values.get(name)
        if x is None:
            return default
        if not isinstance(x, kind) or isinstance(x, bool) and bool not in (kind if isinstance(kind, tuple) else (kind,)):
            raise ValueError(f"{name} is of another type")
        return x

    def string(self, name: str, default: str | None = None) -> str | None:
        return self._get(name, str, default)

    def int(self, name: str, default: int = 0) -> int:
        return self._get(name, int, default)

    def bool(self, name: str, default: bool = False) -> bool:
        return self._get(name, bool, default)

    def _list(self, name: str, kind: type) -> list:
        x = self._get(name, list, [])
        if not all(isinstance(v, kind) for v in x):
            raise ValueError(f"{name} has another type in it")
        return list(x)

    def strings(self, name: str) -> list[str]:
        return self._list(name, str)

    def ints(self, name: str) -> list[int]:
        return self._list(name, int)

    def int_lists(self, name: str) -> list[list[int]]:
        return self._list(name, list)

    def plugins(self, name: str) -> list[Settings]:
        out = []
        for x in self._list(name, dict):
            if "class" not in x:
                raise ValueError(f"an entry of {name} has no class")
            out.append(Settings(x, self.anchor))
        return out

    def with_fallback(self, other: Settings) -> Settings:
        """These settings, with the other's where these have none; a plugin's own fall back to the other's of its class."""
        out = {**other.values, **{k: v for k, v in self.values.items() if v is not None}}
        for name in PLUGINS:
            theirs = {p.values["class"]: p.values for p in other.plugins(name)}
            if name in self.values:
                out[name] = [{**theirs.get(p.values["class"], {}), **p.values} for p in self.plugins(name)]
        return Settings(out, self.anchor.then(other.anchor))


@dataclass
class Parts:
    """All that analysis needs, as sent to tasks."""

    lookup: Lookup
    table: CharTable
    inputs: list
    providers: list
    rewriters: list
    allow_empty: bool = True
    #: Parts of speech of the system dictionary, after which those of user dictionaries come.
    system_pos: int = 0


def _short(name: str) -> str:
    return name.rsplit(".", 1)[-1].removesuffix("Plugin")


def pos_of(lookup: Lookup, pos: list[str], user_pos: str = "forbid") -> int:
    """The number of a part of speech; an unknown one is registered if user_pos is allow, else an error."""
    k = lookup.pos_id(pos)
    if k >= 0:
        return k
    if (user_pos or "forbid").lower() == "allow":
        return lookup.register_pos(pos)
    if (user_pos or "forbid").lower() != "forbid":
        raise ValueError(f"userPOS is forbid or allow, not {user_pos}")
    raise ValueError(f"no part of speech {','.join(pos)}")


def _normalize(s: Settings, lookup: Lookup):
    replaced, kept = definitions.read_rewrites(s.anchor.text(s.string("rewriteDef"))) if s.string("rewriteDef") else definitions.default_rewrites()
    return Normalize(replaced, kept)


def _templates(s: Settings, lookup: Lookup):
    properties = definitions.read_properties(s.anchor.text(s.string("charDef")) if s.string("charDef") else definitions.CATEGORIES_BY_DEFAULT)
    if not s.string("unkDef"):
        raise ValueError("unkDef is missing")
    return oov.Templates(properties, definitions.read_templates(s.anchor.text(s.string("unkDef")), properties, lambda p: pos_of(lookup, p, s.string("userPOS"))))


def _pattern(s: Settings, lookup: Lookup):
    pos = s.strings("oovPOS") or s.strings("pos")
    if not s.string("regex"):
        raise ValueError("regex is missing")
    return oov.Pattern(s.string("regex"), s.int("leftId"), s.int("rightId"), s.int("cost"), pos_of(lookup, pos, s.string("userPOS")), s.int("maxLength", 32), s.string("boundaries", "strict"))


def _join_katakana(s: Settings, lookup: Lookup):
    if not s.strings("oovPOS"):
        raise ValueError("oovPOS is missing")
    return paths.JoinKatakana(pos_of(lookup, s.strings("oovPOS")), s.int("minLength", 1))


#: Plugins by name; register() adds to them. A factory takes the plugin's settings and the lookup.
FACTORIES = {
    "DefaultInputText": _normalize,
    "ProlongedSoundMark": lambda s, k: Prolonged(s.strings("prolongedSoundMarks"), s.string("replacementSymbol", "ー")),
    "ProlongedSoundMarkInputText": lambda s, k: Prolonged(s.strings("prolongedSoundMarks"), s.string("replacementSymbol", "ー")),
    "IgnoreYomigana": lambda s, k: Yomigana(s.strings("leftBrackets"), s.strings("rightBrackets"), s.int("maxYomiganaLength", 4)),
    "MeCabOovProvider": _templates,
    "SimpleOovProvider": lambda s, k: oov.Simple(s.int("leftId"), s.int("rightId"), s.int("cost"), pos_of(k, s.strings("oovPOS"), s.string("userPOS"))),
    "RegexOovProvider": _pattern,
    "JoinNumeric": lambda s, k: paths.JoinNumbers(pos_of(k, ["名詞", "数詞", "*", "*", "*", "*"]), s.bool("enableNormalize", True)),
    "JoinKatakanaOov": _join_katakana,
}


def register(name: str, factory) -> None:
    """Makes a plugin known: a rewriter with edits(), a provider with candidates(), or a path rewriter with rewrite()."""
    FACTORIES[_short(name)] = factory


def _make(s: Settings, lookup: Lookup):
    path = s.string("class")
    if _short(path) in FACTORIES:
        return FACTORIES[_short(path)](s, lookup)
    # A class or function of one's own, module.name; executors must be able to import the module as well.
    module, _, name = path.rpartition(".")
    try:
        factory = getattr(import_module(module), name) if module else None
    except (ImportError, AttributeError) as e:
        raise ValueError(f"no plugin {path}") from e
    if factory is None:
        raise ValueError(f"no plugin {path}")
    return factory(s, lookup)


def assemble(settings: Settings, system: Dictionary, users: list[Dictionary] = ()) -> Parts:
    """Opens an engine: system dictionary, edited connections, categories, plugins (one provider at least), user dictionaries."""
    from ..operators.analyze import estimate_cost

    lookup = Lookup.of(system)
    system_pos = len(system.pos)
    for p in settings.plugins("editConnectionCostPlugin"):
        if _short(p.string("class")) == "InhibitConnection":
            lookup.matrix = lookup.matrix.with_inhibited([tuple(x) for x in p.int_lists("inhibitedPair")])
        else:
            lookup.matrix = _make(p, lookup)(lookup.matrix)
    name = settings.string("characterDefinitionFile")
    table = CharTable(definitions.read_categories(settings.anchor.text(name) if name else definitions.CATEGORIES_BY_DEFAULT))
    make = lambda kind: [_make(p, lookup) for p in settings.plugins(kind)]
    parts = Parts(lookup, table, make("inputTextPlugin"), make("oovProviderPlugin"), make("pathRewritePlugin"), settings.bool("allowEmptyMorpheme", True), system_pos)
    if not parts.providers:
        raise ValueError("no provider of out-of-vocabulary words")
    for d in users:
        lookup.add_user(d, system_pos, lambda k, surface: estimate_cost(parts, surface))
    return parts


def dictionaries(spark, settings: Settings) -> tuple[Dictionary, list[Dictionary]]:
    """The dictionaries that settings name by their folders, systemDict and userDict."""
    if not settings.string("systemDict"):
        raise ValueError("systemDict is missing")
    system = load_dictionary(spark, settings.anchor.resolve(settings.string("systemDict")))
    return system, [load_dictionary(spark, settings.anchor.resolve(p), system) for p in settings.strings("userDict")]


def load_dictionary(spark, path: str, system: Dictionary | None = None) -> Dictionary:
    """A dictionary from its folder of tables, or from a compiled binary file."""
    return binary.read(read_bytes(path), system) if is_file(path) else lexicon.load(spark, path)
