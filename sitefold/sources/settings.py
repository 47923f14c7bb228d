"""An instance's settings: an INI file in its folder, and plug-in files."""

from __future__ import annotations

import configparser
import importlib.util
import inspect
import shutil
from pathlib import Path
from types import ModuleType

from ..operators.extract import Fields

FILE = "sitefold.ini"


def parse_bool(x: object, default: bool = False) -> bool:
    if x is None or str(x).strip() == "":
        return default
    return str(x).strip().lower() in ("1", "true", "yes", "on")


class Settings:
    """Sections Instance, Source, Extractor and Database of folder/sitefold.ini."""

    def __init__(self, folder: str):
        self.folder = Path(folder)
        self.ini = configparser.ConfigParser(interpolation=None)
        self.ini.read(self.folder / FILE, encoding="utf-8")

    def _get(self, section: str, key: str) -> str | None:
        return self.ini.get(section, key, fallback=None) or None

    def _set(self, section: str, key: str, value: object) -> None:
        if not self.ini.has_section(section):
            self.ini.add_section(section)
        self.ini.set(section, key, str(value))
        self.folder.mkdir(parents=True, exist_ok=True)
        with (self.folder / FILE).open("w", encoding="utf-8") as f:
            self.ini.write(f)

    target_folder = property(lambda self: self._get("Instance", "target_folder"), lambda self, v: self._set("Instance", "target_folder", v))
    source_file = property(lambda self: self._get("Source", "file"), lambda self, v: self._set("Source", "file", v))
    delete_after = property(lambda self: parse_bool(self._get("Extractor", "delete")), lambda self, v: self._set("Extractor", "delete", v))
    addon_file = property(lambda self: self._get("Extractor", "addon"))
    use_database = property(lambda self: parse_bool(self._get("Database", "use"), True), lambda self, v: self._set("Database", "use", v))

    def keep_addon(self, path: str) -> str:
        """Copies a plug-in file into the instance."""
        self.folder.mkdir(parents=True, exist_ok=True)
        to = self.folder / Path(path).name
        if Path(path).resolve() != to.resolve():
            shutil.copy2(path, to)
        self._set("Extractor", "addon", to)
        return str(to)

    def initialised(self) -> bool:
        return self.target_folder is not None and (self.folder / FILE).exists()

    def restore(self, target_folder: str) -> bool:
        """Takes up an instance whose target folder is there already."""
        if not Path(target_folder).is_dir():
            return False
        self.target_folder = target_folder
        return True


class FieldPlugin:
    """Base of plug-in classes: every method extract_<name>(page) gives a field <name>."""

    def fields(self) -> Fields:
        found = {n.removeprefix("extract_"): getattr(self, n) for n in dir(self) if n.startswith("extract_")}
        return Fields(page=found)


def load_plugin(path: str | None) -> tuple[Fields | None, str]:
    """The fields of a file's one FieldPlugin class, or why there are none."""
    if not path:
        return None, "no file is set"
    if not Path(path).is_file():
        return None, f"{path} isn't there"
    spec = importlib.util.spec_from_file_location(Path(path).stem, path)
    module: ModuleType = importlib.util.module_from_spec(spec)
    try:
        spec.loader.exec_module(module)
    except Exception as e:  # a broken plug-in is reported
        return None, f"{path} can't be read: {e}"
    found = [c for _, c in inspect.getmembers(module, inspect.isclass) if issubclass(c, FieldPlugin) and c is not FieldPlugin]
    if len(found) != 1:
        return None, f"{path} has {len(found)} plug-in classes; it needs one"
    return found[0]().fields(), "ok"


def has_crawled_data(target_folder: str) -> bool:
    p = Path(target_folder) / "crawled_data"
    return p.is_dir() and any(p.iterdir())
