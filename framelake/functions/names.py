"""Column functions over paths, names, ids, URLs and messages."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# fixed values: grammars of names, suffixes of outputs
#: Camera ids: an alphanumeric, then 1 to 63 of letters, digits, _ and -.
CAMERA_ID = r"^[A-Za-z0-9][A-Za-z0-9_-]{1,63}$"
IMAGE_NAME = r"(?i)^[^.].*\.(jpg|jpeg|png)$"
JOB_ID = r"^[A-Za-z0-9._-]{1,128}$"
ARCHIVE = r"(?i)\.(zip|7z|rar)$"
#: Punctuation around a token that is no part of a path in it.
AROUND = r"""['"()\[\]{}<>,;:.!?]"""


def normalised_path(path: Column) -> Column:
    """Backslashes become slashes; leading ./ and / go."""
    return F.regexp_replace(F.regexp_replace(F.translate(path, "\\", "/"), r"^(\./)+", ""), r"^/+", "")


def valid_camera_id(c: Column) -> Column:
    return c.rlike(CAMERA_ID)


def is_image_name(name: Column) -> Column:
    return name.rlike(IMAGE_NAME)


def image_format(name: Column) -> Column:
    ext = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(ext == "jpeg", "jpg").otherwise(ext)


def classify_entry(path: Column) -> Column:
    """struct(kind, camera_id, out_name, format): Image, Directory or Other.

    ``camera/…/file``: the last folder is the camera. ``A_B_rest``: the first two segments are. A path with a segment ..
    is Other whatever else it is."""
    p = normalised_path(path)
    traversal = F.array_contains(F.split(p, "/"), "..")
    file = F.regexp_extract(p, r"([^/]*)$", 1)
    folder = F.regexp_extract(p, r"([^/]*)/[^/]*$", 1)
    prefix = F.regexp_extract(p, r"^([^_]*_[^_]*)", 1)
    nested = p.contains("/")
    camera = F.when(nested, folder).otherwise(F.when(p.contains("_"), prefix))
    image = ~traversal & valid_camera_id(F.coalesce(camera, F.lit(""))) & is_image_name(F.when(nested, file).otherwise(p))
    kind = F.when(traversal, "Other").when((p == "") | p.endswith("/"), "Directory").when(image, "Image").otherwise("Other")
    is_image = kind == "Image"
    return F.struct(kind.alias("kind"), F.when(is_image, camera).alias("camera_id"), F.when(is_image, p).alias("out_name"), F.when(is_image, image_format(file)).alias("format"))


def stem(name: Column) -> Column:
    """The name without its last extension; a name that is all extension stays."""
    return F.when(name.rlike(r"^.+\.[^.]*$"), F.regexp_extract(name, r"^(.+)\.[^.]*$", 1)).otherwise(name)


def base_name(key: Column) -> Column:
    return F.regexp_extract(key, r"([^/]*)$", 1)


def output_name(name: Column) -> Column:
    return F.concat(stem(name), F.lit("_elaborato.zip"))


def error_name(name: Column) -> Column:
    return F.concat(stem(name), F.lit("_error.txt"))


def default_output_key(key: Column) -> Column:
    return F.concat(F.lit("elaborati/"), stem(base_name(key)), F.lit("_elaborato.zip"))


def replace_ext(name: Column, ext: str) -> Column:
    return F.when(name.contains("."), F.regexp_replace(name, r"\.[^.]*$", f".{ext}")).otherwise(F.concat(name, F.lit(f".{ext}")))


def sanitize_filename(name: Column) -> Column:
    safe = F.regexp_replace(name, "[^A-Za-z0-9._-]", "_")
    return F.when(safe == "", "output").otherwise(safe)


def sanitize_serial(raw: Column) -> Column:
    """A serial number as a camera id, or null if it can't be one."""
    s = F.regexp_replace(F.trim(F.regexp_replace(raw, "\u0000", "")), "[^A-Za-z0-9_-]", "_")
    s = F.regexp_replace(F.regexp_replace(s, "^_+", ""), "_+$", "")
    return F.when((F.length(s) >= 2) & s.rlike("^[A-Za-z0-9]"), F.substring(s, 1, 64))


def safe_job_id(c: Column) -> Column:
    return c.rlike(JOB_ID) & ~c.contains("..")


def ignored_key(key: Column) -> Column:
    """Object keys that a sweep skips."""
    return (key == "") | key.startswith("/") | F.array_contains(F.split(key, "/"), "errori") | ~key.rlike(ARCHIVE)


def archive_kind(name: Column) -> Column:
    ext = F.lower(F.regexp_extract(name, r"\.([^./]*)$", 1))
    return F.when(ext.isin("zip", "7z", "rar"), ext).otherwise("unsupported")


def redact_paths(message: Column) -> Column:
    """Tokens between spaces that are absolute paths (POSIX, drive or UNC) become <path>; punctuation around them stays, and
    so do URLs."""

    def one(token: Column) -> Column:
        core = F.regexp_replace(F.regexp_replace(token, f"^{AROUND}+", ""), f"{AROUND}+$", "")
        pathlike = core.rlike(r"^(/.|\\\\|[A-Za-z]:[\\/])")
        lead = F.regexp_extract(token, f"^({AROUND}*)", 1)
        tail = F.regexp_extract(token, f"({AROUND}*)$", 1)
        return F.when(pathlike & ~core.rlike("^https?://"), F.concat(lead, F.lit("<path>"), tail)).otherwise(token)

    return F.array_join(F.transform(F.split(message, " "), one), " ")


def log_safe(c: Column) -> Column:
    return F.regexp_replace(c, r"[\x00-\x1F\x7F]", "?")


def redact_url(url: Column) -> Column:
    """User and password of a URL's authority become ***, up to its last @."""
    return F.regexp_replace(url, r"^([^:]*://)[^/?#]*@([^/?#@]*)", "$1***@$2")


def percent_encode(c: Column) -> Column:
    """All but letters, digits and -_.~ as %XX of their UTF-8 bytes."""
    e = F.url_encode(c)
    for a, b in ((r"\+", "%20"), (r"\*", "%2A"), ("%7E", "~")):
        e = F.regexp_replace(e, a, b)
    return e


def webhook_allowed(url: Column, hosts: list[str]) -> Column:
    """http or https to an allowed host, or host:port with the scheme's own port where none is given."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    authority = F.regexp_extract(url, r"^[^:]*://(?:[^/?#@]*@)?([^/?#]*)", 1)
    host = F.lower(F.regexp_extract(authority, r"^([^:]*)", 1))
    given = F.regexp_extract(authority, r":([0-9]+)$", 1)
    port = F.when(given != "", given).when(scheme == "https", "443").otherwise("80")
    allowed = F.array(*[F.lit(h) for h in hosts]) if hosts else F.array().cast("array<string>")
    return scheme.isin("http", "https") & (host != "") & (F.array_contains(allowed, host) | F.array_contains(allowed, F.concat(host, F.lit(":"), port)))


def public_ipv4(ip: Column) -> Column:
    """Whether a dotted IPv4 address is globally routable; null for other text."""
    o = [F.try_element_at(F.split(ip, r"\."), F.lit(k + 1)).try_cast("int") for k in range(4)]
    valid = ip.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") & (F.greatest(*o) <= 255)
    a, b, c, d = o
    private = (
        (a == 127) | (a == 10) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 169) & (b == 254))
        | ((a == 192) & (b == 0) & (c == 2)) | ((a == 198) & (b == 51) & (c == 100)) | ((a == 203) & (b == 0) & (c == 113))
        | ((a == 0) & (b == 0) & (c == 0) & (d == 0)) | a.between(224, 239) | ((a == 100) & b.between(64, 127)) | ((a == 192) & (b == 0) & (c == 0)) | (a >= 240)
    )
    return F.when(valid, ~private)


def _plain_address(address: pd.Series) -> pd.Series:
    """``v4:`` and the address for IPv4, also where it is mapped into IPv6; ``v6:`` and the full form; null for other text."""

    def one(text: str | None) -> str | None:
        try:
            ip = ipaddress.ip_address(text.split("%")[0])
        except (AttributeError, ValueError):
            return None
        if ip.version == 6 and ip.ipv4_mapped:
            ip = ip.ipv4_mapped
        return f"v{ip.version}:{ip.exploded}"

    return address.map(one)


def public_ip(address: Column) -> Column:
    """Whether an IPv4 or IPv6 address is globally routable; null for other text. IPv6 without the unspecified, loopback, unique
    local, link-local, multicast and documentation addresses."""
    plain = F.pandas_udf(_plain_address, StringType())(address)
    six = F.substring(plain, 4, 39)
    private = six.isin("0000:" * 7 + "0000", "0000:" * 7 + "0001") | six.rlike("^(f[cd]|fe[89ab]|ff|2001:0db8)")
    return F.when(F.startswith(plain, F.lit("v4:")), public_ipv4(F.substring(plain, 4, 15))).when(plain.isNotNull(), ~private)


def model_url_allowed(url: Column, allow_http: bool = False) -> Column:
    """https, or http to this machine (or anywhere if allowed), and no user or password."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    authority = F.regexp_extract(url, r"^[^:]*://([^/?#]*)", 1)
    host = F.regexp_extract(F.regexp_replace(authority, "^.*@", ""), r"^([^:]*)", 1)
    loopback = (F.lower(host) == "localhost") | host.rlike(r"^127\.\d+\.\d+\.\d+$")
    return ((scheme == "https") | ((scheme == "http") & (loopback | F.lit(allow_http)))) & (host != "") & ~authority.contains("@")


def model_filename(url: Column) -> Column:
    """The last path segment in a plain character set, never empty or dots only."""
    last = F.regexp_extract(F.regexp_extract(url, r"([^/]*)$", 1), r"^([^?#]*)", 1)
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace(last, "[^A-Za-z0-9._-]", ""), r"^\.+", ""), r"\.+$", "")
    return F.when(clean == "", "model.onnx").otherwise(clean)
