"""Fixed values shared by the operators."""

from __future__ import annotations

from dataclasses import dataclass

KIB, MIB, GIB, TIB = 1024, 1024**2, 1024**3, 1024**4

# Default thresholds.
SMALL_FILE_KIB = 1024
MIN_FOLDER_GIB = 1
MIN_FOLDER_AVG_MIB = 10
IDLE_RUNS = 72

# Days since last access used by the aged-bytes report, oldest first.
AGE_DAYS = (5475, 3650, 1825, 1095, 730, 365, 90, 30)

# Size unit names, one per power of 1024.
SIZE_UNITS = ("B", "KiB", "MiB", "GiB", "TiB", "PiB", "EiB")

# Storage classes that need a retrieval before they can be read.
GLACIER_CLASSES = ("GLACIER", "DEEP_ARCHIVE")

# Bytes that the cloud stores per archived object on top of its content.
OBJECT_OVERHEAD_BYTES = 40 * KIB

# Activity limits in bytes per second over one sampling interval.
SAMPLE_SECONDS = 60
DISK_WRITE_LIMIT = 100_000
NET_SENT_LIMIT = 1_000
NET_RECV_LIMIT = 1_000

# Fixed values: (class, name, storage $/TiB/month low, high, retrieval time, retrieval $/TiB).
STORAGE_TIERS = (
    ("INTELLIGENT_TIERING", "Intelligent-Tiering", "2.50", "23.00", "Automatic", "0.00"),
    ("STANDARD_IA", "Standard-IA", "12.50", "12.50", "Milliseconds", "10.00"),
    ("ONEZONE_IA", "One Zone-IA", "10.00", "10.00", "Milliseconds", "10.00"),
    ("GLACIER_IR", "Glacier Instant Retrieval", "4.00", "4.00", "Milliseconds", "10.00"),
    ("GLACIER", "Glacier Flexible Retrieval", "3.60", "3.60", "3-5 hours", "10.00"),
    ("DEEP_ARCHIVE", "Glacier Deep Archive", "1.00", "1.00", "12-48 hours", "2.50"),
)

# Fixed values: (class, option, $/TiB or None, hours low, hours high, supported).
RETRIEVAL_OPTIONS = (
    ("DEEP_ARCHIVE", "Bulk", "2.50", 0.0, 48.0, True),
    ("DEEP_ARCHIVE", "Standard", "10.00", 0.0, 12.0, True),
    ("DEEP_ARCHIVE", "Expedited", None, None, None, False),
    ("GLACIER", "Bulk", "2.50", 5.0, 12.0, True),
    ("GLACIER", "Standard", "10.00", 3.0, 5.0, True),
    ("GLACIER", "Expedited", "30.00", 1 / 60, 5 / 60, True),
)

# Fixed values: $/TiB for a download out of the cloud, over the internet and over a direct line.
EGRESS_USD_PER_TIB = 90.0
EGRESS_DIRECT_USD_PER_TIB = 20.0

# Machine types and their local disk in GB.
MACHINE_DISK_GB = {
    "i3en.24xlarge": 60000,
    "i3en.12xlarge": 30000,
    "i3en.6xlarge": 15000,
    "i3en.3xlarge": 7500,
    "i3en.xlarge": 2500,
    "i3en.large": 1250,
    "c5ad.large": 75,
    "t3a.micro": 5,
}

# Characters that a search text must not hold; each becomes a blank.
SEARCH_PUNCTUATION = ",:?'$^%&*!`~+={}\\[]\""

# Directory names that a crawl never descends into.
SNAPSHOT_DIRS = (".snapshot",)


@dataclass(frozen=True)
class MetaFiles:
    """Names of the files that an archiving tool leaves behind in each folder.

    The names follow one rule, so archives made under another tool name are read
    by passing that name.
    """

    tool: str = "Coldledger"

    @property
    def manifest(self) -> str:
        return f"{self.tool}.allfiles.csv"

    @property
    def bundle(self) -> str:
        return f"{self.tool}.smallfiles.tar"

    @property
    def md5(self) -> str:
        return f".{self.tool.lower()}.md5sum"

    @property
    def md5_restored(self) -> str:
        return f".{self.tool.lower()}-restored.md5sum"

    @property
    def moved_note(self) -> str:
        return "Where-did-the-files-go.txt"

    @property
    def all_meta(self) -> tuple[str, ...]:
        """Ignored when a folder is tested for content and for its newest file."""
        return (self.manifest, self.md5, self.md5_restored, self.moved_note)

    @property
    def not_hashed(self) -> tuple[str, ...]:
        """Left out of a checksum manifest; the file manifest itself is hashed."""
        return (self.md5, self.md5_restored, self.moved_note)

    @property
    def keep_standard(self) -> tuple[str, ...]:
        """Never moved to another storage class."""
        return (self.manifest, self.md5, self.md5_restored)


META = MetaFiles()
