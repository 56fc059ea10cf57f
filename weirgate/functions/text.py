"""Normalisation of text for detection, as columns; only compatibility folding needs Python, and only where it can change a text."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Characters that are removed, direction overrides, and look-alikes with their Latin letters.
INVISIBLE = r"[\x{0000}\x{00AD}\x{200B}-\x{200F}\x{202A}-\x{202F}\x{2060}-\x{2069}\x{FEFF}]"
OVERRIDES = r"[\x{202A}-\x{202E}\x{2066}-\x{2069}]"
LOOK_ALIKES = "аеорсуіѕαεορκινıɡ"
LATIN = "aeopcyisaeopkivig"

#: Characters that compatibility folding leaves alone wherever they stand; a text of these never goes to Python.
STABLE = r"^[\x00-\x7F\x{A1}-\x{A7}\x{A9}\x{AB}-\x{AE}\x{B0}\x{B1}\x{B6}\x{B7}\x{BB}\x{BF}-\x{131}\x{134}-\x{13E}\x{141}-\x{148}\x{14A}-\x{17E}\x{400}-\x{482}\x{48A}-\x{52F}\x{2012}-\x{2016}\x{2018}-\x{2023}]*+$"


#: Characters that no step of the normalisation touches: a text of these is its own normal form.
PLAIN = r"^[\x01-\x7F\x{A1}-\x{A7}\x{A9}\x{AB}\x{AC}\x{AE}\x{B0}\x{B1}\x{B6}\x{B7}\x{BB}\x{BF}-\x{130}\x{134}-\x{13E}\x{141}-\x{148}\x{14A}-\x{17E}\x{2012}-\x{2016}\x{2018}-\x{2023}]*+$"


@F.pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


#: Declared so, the optimiser neither copies it into filters nor asks it twice: it is the one step outside the JVM.
_nfkc = _nfkc.asNondeterministic()


def is_plain(x: Column) -> Column:
    """ASCII texts are told by their lengths alone."""
    return F.when(F.octet_length(x) == F.length(x), ~F.contains(x, F.lit("\0"))).otherwise(x.rlike(PLAIN))


def folded(stripped: Column, plain: Column) -> Column:
    """nfkc of the stripped text, where the text isn't plain."""
    return F.coalesce(_nfkc(F.when(~plain, F.when(~stripped.rlike(STABLE), stripped))), stripped)


def rtl_overrides(x: Column) -> Column:
    return x.rlike(OVERRIDES)


def strip_invisible(x: Column) -> Column:
    return F.regexp_replace(x, INVISIBLE, "")


def nfkc(x: Column) -> Column:
    return F.coalesce(_nfkc(F.when(~x.rlike(STABLE), x)), x)


def map_look_alikes(x: Column) -> Column:
    return F.translate(x, LOOK_ALIKES, LATIN)


def normalised(x: Column) -> Column:
    """struct(normalized, invisible_chars_stripped, confusables_normalized, rtl_overrides_detected)."""
    stripped = strip_invisible(x)
    mapped = map_look_alikes(nfkc(stripped))
    return F.struct(mapped.alias("normalized"), (F.length(x) - F.length(stripped)).alias("invisible_chars_stripped"), (mapped != stripped).alias("confusables_normalized"), rtl_overrides(x).alias("rtl_overrides_detected"))


def utf16_length(x: Column) -> Column:
    """Length in UTF-16 units, where callers count so; everything else here counts code points."""
    return (F.octet_length(F.encode(x, "UTF-16BE")) / 2).cast("int")


def truncated(x: Column, most: int) -> Column:
    return F.when(F.length(x) > most, F.concat(F.left(x, F.lit(most - 3)), F.lit("..."))).otherwise(x)


def hmac_sha256(key: str, x: Column) -> Column:
    """Hex HMAC-SHA256 with a key known when the plan is made; its pads are part of the plan."""
    import hashlib

    raw = key.encode()
    raw = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    inner = F.sha2(F.concat(F.lit(bytearray(b ^ 0x36 for b in raw)), F.encode(x, "UTF-8")), 256)
    return F.sha2(F.concat(F.lit(bytearray(b ^ 0x5C for b in raw)), F.unhex(inner)), 256)


def millis(ts: Column | str) -> Column:
    """Epoch milliseconds of a timestamp; one without a zone is taken in the session's, which is to be UTC."""
    return F.unix_millis((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))
