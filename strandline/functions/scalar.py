"""Column functions of telemetry: bands, severities, origins and patterns of processes, clamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accounts and parents of system services, the parent of what a user starts, programs that should not start
#: others, shells, folders of downloads, switches of hidden commands, and names of the system's own processes.
SYSTEM_ACCOUNTS = ("SYSTEM", "LOCAL SERVICE", "NETWORK SERVICE", "NT AUTHORITY\\SYSTEM")
OFFICE = ("WINWORD", "EXCEL", "POWERPNT", "OUTLOOK")
BROWSERS = ("chrome", "firefox", "msedge", "iexplore")
SHELLS = ("powershell.exe", "cmd.exe", "wscript.exe", "cscript.exe")
LOOSE_FOLDERS = ("\\Temp\\", "\\Downloads\\")
HIDING = ("-enc", "-encodedcommand")
NOISE = (
    "System", "Idle", "Registry", "smss.exe", "csrss.exe", "wininit.exe", "services.exe", "lsass.exe", "svchost.exe", "dwm.exe", "winlogon.exe", "fontdrvhost.exe", "WUDFHost.exe", "conhost.exe", "sihost.exe",
    "taskhostw.exe", "RuntimeBroker.exe", "spoolsv.exe", "SearchIndexer.exe", "MsMpEng.exe", "SgrmBroker.exe", "SecurityHealthService.exe", "audiodg.exe", "dllhost.exe", "WmiPrvSE.exe", "CompPkgSrv.exe",
)


def score_band(score: Column, high: float = 0.8, medium: float = 0.4) -> Column:
    return F.when(score >= high, "high").when(score >= medium, "medium").otherwise("low")


def severity(score: Column) -> Column:
    return F.when(score >= 0.9, "critical").when(score >= 0.8, "high").otherwise("medium")


def disk_severity(free: Column, daily: Column) -> Column:
    """critical under a day's use, warning under three; else null."""
    return F.when(free < daily, "critical").when(free < 3 * daily, "warning")


def _holds(text: Column, parts: tuple[str, ...]) -> Column:
    """Whether a text holds any of the parts; false where it is null."""
    found = F.lit(False)
    for p in parts:
        found = found | F.contains(text, F.lit(p))
    return F.coalesce(found, F.lit(False))


def process_origin(parent: Column, user: Column, path: Column) -> Column:
    """Who started a process; a parent or path that is null or empty is unknown, and an unknown parent is an external start."""
    system = F.coalesce(F.upper(user).isin(*SYSTEM_ACCOUNTS), F.lit(False))
    own = _holds(path, ("Users\\",)) & _holds(path, ("\\AppData\\",))
    return (
        F.when(system, "system_service")
        .when(_holds(F.lower(parent), ("explorer.exe",)) | own, "user_initiated")
        .when(_holds(F.lower(parent), ("services.exe",)), "system_service")
        .when(F.coalesce(parent, F.lit("")) == "", "external_triggered")
        .otherwise("unknown")
    )


def suspicious(name: Column, parent: Column, path: Column, command: Column) -> Column:
    """Whether an office program started an executable, a browser a shell, the file lies in a folder of downloads, or PowerShell
    got an encoded command."""
    low = F.coalesce(F.lower(name), F.lit(""))
    office = _holds(F.upper(parent), OFFICE) & F.endswith(low, F.lit(".exe"))
    shell = _holds(F.lower(parent), BROWSERS) & low.isin(*SHELLS)
    hidden = _holds(low, ("powershell",)) & _holds(F.lower(command), HIDING)
    return office | shell | _holds(path, LOOSE_FOLDERS) | hidden


def is_noise(name: Column) -> Column:
    """Whether the process is one of the system's own, by its exact name."""
    return F.coalesce(name.isin(*NOISE), F.lit(False))


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def replay_clock(wall_us: Column, start_us: int, anchor_us: int, speed: float = 1.0, offset_us: int = 0) -> Column:
    return (F.lit(start_us) + (wall_us - anchor_us) * speed + offset_us).cast("long")


def quantize(luma: Column, palette: int = 10) -> Column:
    return F.least(F.floor(luma / (256 // palette)), F.lit(palette - 1)).cast("int")
