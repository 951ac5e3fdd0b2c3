"""Configuration on the driver: YAML-like, JSON and Python-literal files, and overrides."""

from __future__ import annotations

import ast
import json
import os

DEFAULTS: dict = {
    "project": "", "version": "1.0.0", "release": "1.0.0", "copyright": "", "author": None, "root_doc": "index", "language": "en", "parallel_jobs": 0, "max_cache_size_mb": 500, "cache_expiration_hours": 24,
    "include_patterns": ["**"], "exclude_patterns": [], "fail_on_warning": False, "nitpicky": False, "validate_directives": True, "extensions": ["autodoc", "viewcode", "intersphinx"], "tags": [], "doctree_dir": None,
    "templates_path": ["_templates"], "template_dirs": [], "static_dirs": [], "source_suffix": [".rst"],
    "output": {"html_theme": "default", "syntax_highlighting": True, "highlight_theme": "github", "search_index": True, "minify_html": False, "compress_output": False},
    "theme": {"name": "default", "options": {}, "custom_css": [], "custom_js": []},
    "optimization": {"parallel_processing": True, "incremental_builds": True, "document_caching": True, "image_optimization": False, "asset_bundling": False},
    "html_style": [], "html_css_files": [], "html_js_files": [], "html_static_path": ["_static"], "html_extra_path": [], "html_logo": None, "html_favicon": None, "html_title": None, "html_short_title": None, "html_show_copyright": True,
    "html_show_tool": True, "html_copy_source": True, "html_show_sourcelink": True, "html_sourcelink_suffix": ".txt", "html_use_index": True, "html_split_index": False, "html_use_opensearch": False, "html_last_updated_fmt": "%b %d, %Y",
    "html_context": {}, "html_theme_options": {}, "html_file_suffix": ".html", "html_link_suffix": ".html", "html_output_encoding": "utf-8", "html_compact_lists": True, "html_secnumber_suffix": ". ", "html_search_language": "en",
    "html_search_options": {}, "html_search_scorer": "", "html_scaled_image_link": True, "html_baseurl": "", "html_codeblock_linenos_style": "inline", "html_math_renderer": "mathjax", "html_math_renderer_options": {}, "locale_dirs": [],
    "gettext_compact": True, "gettext_uuid": False, "gettext_location": True, "gettext_auto_build": True, "gettext_additional_targets": [], "needs_version": None, "numfig": False, "numfig_secnum_depth": 1, "math_number_all": False,
    "math_eqref_format": None, "math_numfig": True, "tls_verify": True, "tls_cacerts": "", "user_agent": None,
}
#: Other names of settings: all that one sets.
ALIASES = {"master_doc": ["root_doc"], "html_theme": ["output.html_theme", "theme.name"], "templates_path": ["templates_path", "template_dirs"], "html_static_path": ["html_static_path", "static_dirs"]}
#: Lists that a Python file sets even where it doesn't name them: to nothing.
REPLACED = ["extensions", "exclude_patterns", "html_css_files", "html_js_files"]
FILES = ["conf.py", "config.yaml", "config.yml", "config.json"]


def python_literals(text: str) -> tuple[dict, list[tuple[int, str]]]:
    """The assignments of literals in a Python file, and (line, what) of all that is left out."""
    out: dict = {}
    dropped: list[tuple[int, str]] = []
    try:
        tree = ast.parse(text)
    except SyntaxError as e:
        return {}, [(e.lineno or 0, "syntax error")]
    for node in tree.body:
        if isinstance(node, ast.Assign) and len(node.targets) == 1 and isinstance(node.targets[0], ast.Name):
            try:
                out[node.targets[0].id] = ast.literal_eval(node.value)
            except (ValueError, TypeError, SyntaxError):
                dropped.append((node.lineno, f"value of {node.targets[0].id} is no literal"))
        elif not (isinstance(node, ast.Expr) and isinstance(node.value, ast.Constant)):
            dropped.append((node.lineno, type(node).__name__))
    return out, dropped


def merged(over: dict, base: dict | None = None) -> dict:
    """base (the defaults) with the values of over; dictionaries are merged, all else replaced."""
    out = dict(DEFAULTS if base is None else base)
    for k, v in over.items():
        out[k] = merged(v, out[k]) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def load(folder: str) -> tuple[dict, list[tuple[int, str]]]:
    """The configuration of the first file there is, over the defaults."""
    for name in FILES:
        path = os.path.join(folder, name)
        if not os.path.exists(path):
            continue
        with open(path, encoding="utf-8") as f:
            text = f.read()
        if name.endswith(".py"):
            values, dropped = python_literals(text)
            return from_python(values), dropped
        if name.endswith(".json"):
            return merged(json.loads(text)), []
        try:
            import yaml
        except ImportError:
            raise ValueError(f"{path}: no YAML reader is installed") from None
        return merged(yaml.safe_load(text) or {}), []
    return dict(DEFAULTS), []


def defaults() -> dict:
    return merged({})


def from_python(values: dict) -> dict:
    """The configuration of a Python file's literals: known settings of the right type,
    under all their names; others are left out, and the lists of REPLACED are empty
    unless it sets them."""
    out = merged(dict.fromkeys(REPLACED, []))
    for k, v in values.items():
        if k not in DEFAULTS and k not in ALIASES:
            continue
        had = DEFAULTS.get(k)
        if k in DEFAULTS and had is not None and v is not None and (type(had) is not type(v)) and not (isinstance(had, list) and isinstance(v, (str, tuple))):
            continue
        if isinstance(had, list):
            v = [v] if isinstance(v, str) else list(v)
        for name in ALIASES.get(k, [k]):
            _put(out, name, v)
    return out


def save(config: dict, path: str) -> None:
    """As JSON, or as YAML where the name says so and a writer is installed."""
    with open(path, "w", encoding="utf-8") as f:
        if path.endswith((".yaml", ".yml")):
            try:
                import yaml
            except ImportError:
                raise ValueError(f"{path}: no YAML writer is installed") from None
            yaml.safe_dump(config, f, sort_keys=False)
        else:
            json.dump(config, f, indent=2)


def pair(text: str) -> tuple[str, str]:
    """'key=value' in two, by the first '='; without a key it raises."""
    key, eq, value = text.partition("=")
    if not eq or not key.strip():
        raise ValueError(f"expected key=value, got {text!r}")
    return key.strip(), value


def _put(config: dict, key: str, value: object) -> None:
    *above, last = key.split(".")
    for a in above:
        config[a] = dict(config.get(a) or {})
        config = config[a]
    config[last] = value


def override(config: dict, pairs: list[str]) -> tuple[dict, list[str]]:
    """config with 'key=value' pairs, dots going into dictionaries, values of the type
    that is there (for null an integer if it is one, else a string); and warnings of
    unknown keys, whole dictionaries and values of the wrong type."""
    out, warnings = merged({}, config), []
    for one in pairs:
        key, text = pair(one)
        if key in ALIASES and ALIASES[key] != [key]:  # one setting for several
            for name in ALIASES[key]:
                if name != key:
                    out, more = override(out, [f"{name}={text}"])
                    warnings += more
            if key not in DEFAULTS:
                continue
        at: object = out
        for a in key.split("."):
            at = at.get(a, KeyError) if isinstance(at, dict) else KeyError
        if at is KeyError:
            warnings.append(f"unknown key {key}")
        elif isinstance(at, dict):
            warnings.append(f"{key} is a dictionary")
        elif isinstance(at, bool):
            if text.lower() not in ("1", "0", "true", "false"):
                warnings.append(f"{key} is a boolean")
            else:
                _put(out, key, text.lower() in ("1", "true"))
        elif isinstance(at, int) or at is None:
            try:
                _put(out, key, int(text))
            except ValueError:
                if at is None:
                    _put(out, key, text)
                else:
                    warnings.append(f"{key} is a number")
        elif isinstance(at, list):
            _put(out, key, [x for x in text.split(",") if x])
        else:
            _put(out, key, text)
    return out, warnings
