"""Fixed values of the catalog: class and prefix tables, built-in names, weights and limits."""

from __future__ import annotations

# fixed values: setup class -> driver type
CLASS_TO_TYPE = {
    "net": "Net", "nettrans": "Net", "netservice": "Net", "netclient": "Net", "network": "Net",
    "display": "Display", "monitor": "Display",
    "media": "Audio", "audio": "Audio", "hdaudio": "Audio",
    "diskdrive": "Storage", "cdrom": "Storage", "floppydisk": "Storage", "tapedrive": "Storage", "storage": "Storage",
    "scsiadapter": "Storage", "volumesnapshot": "Storage", "volume": "Storage", "mediumchanger": "Storage",
    "usb": "USB", "usbdevice": "USB",
    "bluetooth": "Bluetooth", "bth": "Bluetooth", "bthle": "Bluetooth",
    "hid": "Input", "hidclass": "Input", "keyboard": "Input", "mouse": "Input", "pen": "Input", "tabletinputdevice": "Input",
    "sensor": "Input", "biometric": "Input",
    "system": "Chipset", "processor": "Chipset", "computer": "Chipset", "unknown": "Chipset", "acpi": "Chipset",
    "battery": "Chipset", "smartcardreader": "Chipset",
    "ports": "Ports", "multiportserial": "Ports", "modem": "Ports",
    "image": "Imaging", "camera": "Imaging", "stillimage": "Imaging", "scanner": "Imaging",
    "printer": "Printer", "printqueue": "Printer", "pnpprinters": "Printer",
    "securityaccelerator": "Security", "securitydevices": "Security", "smartcard": "Security",
    "firmware": "Firmware", "softwaredevice": "Firmware", "softwarecomponent": "Firmware",
    "wireless": "Wireless", "wlan": "Wireless", "bluetoothaudio": "Wireless",
    "power": "Power",
    "infrared": "Other", "multifunction": "Other", "1394": "Other", "61883": "Other", "dot4": "Other", "dot4print": "Other",
    "ieeef16": "Other", "extension": "Other",
}
TYPE_FALLBACK = "Other"
# fixed values: hardware id prefix -> driver type that it votes for
PREFIX_VOTES = {
    "USB\\": "USB", "USBSTOR\\": "Storage", "HDAUDIO\\": "Audio", "DISPLAY\\": "Display", "BTH\\": "Bluetooth", "BTHENUM\\": "Bluetooth",
    "HID\\": "Input", "HIDCLASS\\": "Input", "SCSI\\": "Storage", "IDE\\": "Storage", "PCI\\": "Chipset", "ACPI\\": "Chipset",
    "MONITOR\\": "Display", "MEDIA\\": "Audio", "NET\\": "Net", "SD\\": "Storage",
}
# fixed values: bus prefixes of valid hardware ids
HWID_PREFIXES = (
    "PCI", "USB", "USBSTOR", "HDAUDIO", "ACPI", "HID", "SCSI", "IDE", "DISPLAY", "SWD", "ROOT", "STORAGE", "MEDIA", "NET", "BLUETOOTH",
    "WPD", "BTH", "MONITOR", "CDROM", "DISK", "PCIIDE", "SD", "1394", "FTDIBUS", "BTHENUM", "WUDFRD", "LPTENUM", "USBPRINT", "HIDCLASS",
    "ACPI_HAL", "VMBUS", "UEFI",
)
# fixed values: names of drivers that come with the system
BUILTIN_PREFIXES = (
    "1394", "acpi", "battery", "cdrom", "disk", "floppy", "hal", "hidir", "input", "intelide", "isapnp", "keyboard", "kbdclass",
    "machine", "monitor", "mouclass", "mshdc", "msisadrv", "msmouse", "pci", "pcmcia", "pnputil", "storport", "swenum", "usbhub",
    "usbport", "usbccgp", "usbprint", "vdrvroot", "volmgr", "volume", "wdmaudio", "xboxgip",
)
# fixed values: words left out of provider names
PROVIDER_SUFFIXES = "inc corp corporation ltd limited llc co gmbh ag sa bv pty pvt plc technologies technology semiconductor microsystems electronics systems microelectronics solutions group".split()
# fixed values: labels of driver listings -> our columns
LISTING_LABELS = {
    "published name": "published", "inf name": "published", "original name": "original", "original inf name": "original",
    "inf original name": "original", "provider name": "provider", "class name": "class_name", "driver version": "driver_version",
    "driver package path": "pkg_path",
}
# fixed values: weight of each searched column
FIELD_WEIGHTS = {
    "display_name": 1.4, "provider": 1.2, "driver_id": 1.15, "category": 1.0, "driver_type": 1.0, "descriptions": 1.0, "pack": 0.9,
    "version": 0.85, "arch": 0.7, "source_manifest": 0.6, "os_targets": 0.55,
}
# fixed values: search keys -> columns
FIELD_ALIASES = {
    "name": ["display_name"], "display": ["display_name"], "display_name": ["display_name"], "device": ["display_name"],
    "provider": ["provider"], "vendor": ["provider"], "publisher": ["provider"], "mfg": ["provider"], "manufacturer": ["provider"],
    "category": ["category"], "class": ["category"], "type": ["driver_type"], "driver_type": ["driver_type"],
    "id": ["driver_id"], "driver_id": ["driver_id"], "drv": ["driver_id"], "pack": ["pack"],
    "version": ["version"], "ver": ["version"], "v": ["version"], "arch": ["arch"], "architecture": ["arch"], "bits": ["arch"],
    "desc": ["descriptions"], "description": ["descriptions"], "descriptions": ["descriptions"],
    "os": ["os_targets", "source_manifest"], "target": ["os_targets"], "targets": ["os_targets"],
    "manifest": ["source_manifest"], "source": ["source_manifest"],
}
# fixed values: columns that the candidate prefilter looks at
PREFILTER_FIELDS = ("display_name", "provider", "category", "driver_type", "pack", "version", "arch", "descriptions", "os_targets")
# fixed values: system releases by NT version
NT_RELEASES = {(10, 0): "Windows 10/11", (6, 3): "Windows 8.1", (6, 2): "Windows 8", (6, 1): "Windows 7", (6, 0): "Windows Vista"}

MAX_CRITERIA = 8
MATCH_THRESHOLD = 0.0001
CANDIDATE_CAP = 5000
DEFAULT_PAGE_SIZE, MAX_PAGE_SIZE, MAX_PAGE = 25, 100, 1_000_000
ID_PREFIX_LIMIT = 50
JACCARD_THRESHOLD, ARCH_BONUS = 0.25, 1.2
SHARD_LIMIT, SHARD_SPLIT = 15 * 1024 * 1024, 13 * 1024 * 1024
STORAGE_BYTES, STORAGE_WARN, STORAGE_FAIL = 5 * 1024**3, 80.0, 95.0
