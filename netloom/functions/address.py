"""IPv4 addresses as numbers."""

from pyspark.sql import Column
from pyspark.sql import functions as F

_QUAD = r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$"


def ip_to_int(ip: Column) -> Column:
    """Unsigned 32-bit value of a dotted quad, big-endian; NULL unless it has four octets of 0..255."""
    octets = F.transform(F.split(ip, "[.]"), lambda x: x.cast("bigint"))
    small = F.forall(octets, lambda x: x <= 255)
    number = F.aggregate(octets, F.lit(0).cast("bigint"), lambda acc, x: acc * 256 + x)
    return F.when(F.regexp_like(ip, F.lit(_QUAD)), F.when(small, number))
