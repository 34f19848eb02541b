"""What synthesis back ends are sent and send back, as columns: payloads, speaker maps, languages, sound."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from narrata.functions import clean, splitting
from narrata.functions.patterns import lookup
from narrata.functions.remote import Retry

LANGUAGES = {"zh": "Chinese", "en": "English", "es": "Spanish", "ru": "Russian", "it": "Italian", "fr": "French", "ko": "Korean", "ja": "Japanese", "de": "German", "pt": "Portuguese"}


def language_name(explicit: Column, locale: Column, default: str = "Auto") -> Column:
    """The language given, else that of the locale's first part, else the default."""
    return F.coalesce(F.nullif(explicit, F.lit("")), lookup(LANGUAGES, F.substring_index(F.lower(locale), "-", 1)), F.lit(default))


def payload(fields: Mapping[str, Column], omit: str = "", extra: Column | None = None) -> Column:
    """JSON of the fields: those to be omitted go, a JSON object of extra ones is merged over them (one that doesn't parse is ignored),
    nulls are not sent. Values are strings."""
    left_out = {f.strip() for f in omit.split(",")}
    own = F.create_map(*[x for k, c in fields.items() if k not in left_out for x in (F.lit(k), c.cast("string"))])
    more = F.coalesce(F.from_json(extra, "map<string,string>"), F.create_map().cast("map<string,string>")) if extra is not None else F.create_map().cast("map<string,string>")
    kept = F.map_filter(own, lambda k, v: ~F.map_contains_key(more, k) & v.isNotNull())
    return F.to_json(F.map_concat(kept, F.map_filter(more, lambda k, v: v.isNotNull())))


def speaker_map(raw: Column) -> Column:
    """A JSON object of speakers and voices; anything else is an error, nothing is no speaker."""
    got = F.from_json(raw, "map<string,string>")
    empty = F.create_map().cast("map<string,string>")
    return F.when(F.coalesce(raw, F.lit("")) == "", empty).otherwise(F.coalesce(got, F.raise_error(F.concat(F.lit("no JSON object of speakers: "), raw)).cast("map<string,string>")))


def sound(encoded: Column) -> Column:
    return F.unbase64(encoded)


def json_path(document: Column, path: str) -> Column:
    """A dotted path with numbers for places in lists; null where it leads nowhere."""
    return F.get_json_object(document, "$" + "".join(f"[{p}]" if p.isdigit() else f".{p}" for p in path.split(".")))


@dataclass(frozen=True)
class Backend:
    """How a back end is called: pieces of at most ``most_chars`` characters (0: any), each turned into sound by ``speak``, one after the other."""

    name: str
    most_chars: int = 0
    speak: Callable[[str], bytes] | None = None
    retry: Retry = Retry()


#: The back ends that are known by name. None has a function of its own: whoever uses one gives it to ``backend``.
BACKENDS: dict[str, Backend] = {name: Backend(name, clean.MAX_CHARS.get(name, 0)) for name in clean.BREAKS}


def backend(name: str, speak: Callable[[str], bytes], **options) -> Backend:
    """The named back end with the function that calls it; an unknown name is an error."""
    if name not in BACKENDS:
        raise ValueError(f"unknown back end {name!r}; there are {', '.join(sorted(BACKENDS))}")
    return replace(BACKENDS[name], speak=speak, **options)


def synthesized(text: Column, how: Backend) -> Column:
    """struct<sound, n_calls, error> of each text: the sounds of its pieces one after the other, or the error of the piece that failed for good."""
    @F.pandas_udf("struct<sound: binary, n_calls: int, error: string>")
    def run(s: pd.Series) -> pd.DataFrame:
        rows = []
        for t in s:
            pieces = [] if t is None else splitting.sized(t, how.most_chars) if how.most_chars else [t]
            try:
                rows.append((b"".join(how.retry.call(lambda p=p: how.speak(p)) for p in pieces), len(pieces), None))
            except Exception as error:  # whatever the back end raises
                rows.append((None, len(pieces), f"{type(error).__name__}: {error}"))
        return pd.DataFrame(rows, columns=["sound", "n_calls", "error"])

    return run(text)
