"""Patterns and word lists of electrical drawings.

Fixed values: everything in this module must equal the notation used on drawings for the
results to be right; order matters, the first hit decides.
"""

from __future__ import annotations

from typing import NamedTuple


class Pattern(NamedTuple):
    """kind: component type; name: how the id is made of the match; sources: p(df), d(xf), s(heet)."""

    regex: str
    kind: str
    name: str = "{}"
    sources: str = "pds"
    in_label: bool = True


_SUB = r"(?:\.[A-Z0-9.]+)?"
CATALOGUE = (
    Pattern(rf"\b(52-[A-Z0-9]+{_SUB})\b", "52"),
    Pattern(rf"\b(50-[A-Z0-9]+{_SUB})\b", "50"),
    Pattern(rf"\b(51-[A-Z0-9]+{_SUB})\b", "51"),
    Pattern(r"\b(86[A-Z]{1,3}\d*)\b", "86"),
    Pattern(rf"\b(87-[A-Z0-9]+{_SUB})\b", "87"),
    Pattern(rf"\b(89-[A-Z0-9]+{_SUB})\b", "89"),
    Pattern(r"\b(21-[A-Z0-9]+)\b", "21"),
    Pattern(r"\b(25-[A-Z0-9]+)\b", "25"),
    Pattern(r"\b(27-[A-Z0-9]+)\b", "27"),
    Pattern(r"\b(59-[A-Z0-9]+)\b", "59"),
    Pattern(r"\b(67-[A-Z0-9]+)\b", "67"),
    Pattern(r"\b(81-[A-Z0-9]+)\b", "81"),
    Pattern(r"\b(79-[A-Z0-9]+)\b", "79"),
    Pattern(r"\b(SEL-\d{3,4}[A-Z0-9]{0,5})\b", "RELAY"),
    Pattern(r"\b(GE-[A-Z0-9]+)\b", "RELAY"),
    Pattern(r"\bGE\s+(L\d+[A-Z]?)\b", "RELAY", "GE-{}"),
    Pattern(r"\b(ABB-[A-Z0-9]+)\b", "RELAY"),
    Pattern(r"\b(BECKWITH-[A-Z0-9]+)\b", "RELAY", "BECKWITH-{}"),
    Pattern(r"\bBECKWITH\s+(M-?\d+[A-Z]*)\b", "RELAY"),
    Pattern(r"\b(TESLA-?\d+)\b", "RELAY"),
    Pattern(rf"\b(CT-[A-Z0-9]+{_SUB})\b", "CT"),
    Pattern(rf"\b(PT-[A-Z0-9]+{_SUB})\b", "PT"),
    Pattern(rf"\b(VT-[A-Z0-9]+{_SUB})\b", "VT"),
    Pattern(rf"\b(CCVT-[A-Z0-9]+{_SUB})\b", "CCVT"),
    Pattern(r"\b(FU\d+[A-Z]?)\b", "FU"),
    Pattern(r"\b(NGR-[A-Z0-9]+)\b", "NGR"),
    Pattern(r"\b(SW-\d+)\b", "SW"),
    Pattern(r"\b((?:DC\s*)?PANEL\s+(?:\d+[A-Z]?|[A-Z]{1,3}\d+))\b", "PANEL"),
    Pattern(r"\b(86[A-Z]{1,4}\d?)\b", "86", sources="p", in_label=False),
    Pattern(r"\b(DC\s*PANEL\s*[A-Z]*\d*)\b", "PANEL", sources="pd", in_label=False),
    Pattern(r"BREAKER\s+(\d+)", "52", "BREAKER-{}", sources="pd", in_label=False),
    Pattern(r"\bDPAC-?(\d+[A-Z]?)\b", "RELAY", "DPAC-{}"),
    Pattern(r"\b(SEL-C\d{2,})\b", "CABLE"),
    Pattern(r"\b(OUT\d{2,})\b", "RELAY"),
    Pattern(r"\b(IN\d{3,})\b", "RELAY"),
    Pattern(r"\bCIRCUIT\s+(\d+)\b", "52", "CIRCUIT-{}", in_label=False),
    Pattern(r"\bDFR-?(\d+)\b", "DFR", "DFR-{}"),
    Pattern(r"\b(CM-\d+)\b", "DFR"),
    Pattern(r"\b(VM-\d+)\b", "DFR"),
    Pattern(r"\b(CMET-\d+)\b", "CMET"),
    Pattern(r"\bFPP-?(\d+)\b", "FPP", "FPP-{}"),
    Pattern(r"\b(HS\d{2,})\b", "HS"),
    Pattern(r"\b(TEE\d+[A-Z]?)\b", "UNKNOWN"),
    Pattern(r"\b(52[AB])\b", "52"),
    Pattern(r"\b(WSL-\d+[PS]?)\b", "CT"),
    Pattern(r"\b(PS\d+)\b", "PS"),
    Pattern(r"\b(RP\d+)\b", "PANEL"),
    Pattern(r"\b(ETM-T\d+)\b", "RELAY"),
    Pattern(r"\b(LTC-T\d+)\b", "LTC"),
    Pattern(r"\b(SST)\b", "TX"),
    Pattern(r"\b(AC\s*PANEL\s*AC\d+)\b", "PANEL"),
    Pattern(r"\b(FU-[A-Z]{2,})\b", "FU"),
    Pattern(r"\b(BESS-AUX\d+)\b", "BAT"),
    Pattern(r"\b(IRIG-B)\b", "UNKNOWN", in_label=False),
    Pattern(r"\b(TC[12])\b", "52"),
    Pattern(r"\b(LOR)\b", "86"),
    Pattern(r"\b(VDC\d+)\b", "PS"),
    Pattern(r"\b([PS]M68)\b", "RELAY"),
    Pattern(r"\b(C[12348]00)\b", "CT"),
    Pattern(r"\b(TB\d{1,2})\b(?!-)", "TB", in_label=False),
    Pattern(r"\b(TS\d{1,2})\b(?!-)", "TB", in_label=False),
    Pattern(r"\b(RTAC)\b", "RTAC"),
    Pattern(r"\b(CLOCK)\b", "CLOCK"),
    Pattern(r"\b(PDC)\b", "PDC"),
    Pattern(r"\b(CISCO\s+(?:IE-?\d+|CGR-?\d+))\b", "NETSW"),
    Pattern(r"\b(RTR-\d+)\b", "RTR"),
    Pattern(r"\b(BAF-\d+)\b", "FU"),
    Pattern(r"\b(POWER\s*STRIP)\b", "PS"),
    Pattern(r"\b(ATS)\b", "ATS"),
    Pattern(r"\b(RTU)\b", "RTAC"),
    Pattern(r"\b(HVAC-\d+)\b", "UNKNOWN"),
    Pattern(r"\b(BP-\d+)\b", "PT"),
    Pattern(r"\b(EMS-[A-Z]+-?\d*)\b", "RTAC"),
    Pattern(r"\b(BATTERY\s+(?:BANK|CHARGER)\s+#\d+)\b", "BAT"),
    Pattern(r"\b(UPS-?\d*)\b", "UPS"),
    Pattern(r"\b(MCC-?[A-Z0-9]*)\b", "MCC"),
    Pattern(r"\b(SWGR-?[A-Z0-9]*)\b", "SWGR"),
    Pattern(r"\b(VFD-?\d+)\b", "VFD"),
    Pattern(r"\b(PLC-?\d*)\b", "PLC"),
    Pattern(r"\b(RECT-?\d*)\b", "RECT"),
    Pattern(r"\b(MOV-?\d*)\b", "MOV"),
    Pattern(r"\b([LS]A-\d+)\b", "MOV"),
    Pattern(r"\b(SPD-?\d*)\b", "SPD"),
    Pattern(r"\b(REG-?\d*)\b", "REG"),
    Pattern(r"\b(GEN-?\d*)\b", "GEN"),
)

VOLTAGE = r"(\d+\.?\d*)\s*(kV|V|KV)\s*(AC|DC)?"
CURRENT = r"(\d+\.?\d*)\s*(A|kA|MA)\b"
IMPEDANCE = r"(\d+\.?\d*)\s*(%Z|%|[Oo][Hh][Mm]|Ω)"
POWER = r"(\d+(?:/\d+)*)\s*(MVA|KVA|kVA)"
RATIO = r"(\d+(?:/\d+)*:\d+(?::\d+)?)"
CABLE = r"(\d+/C\s*#\d+\w*)"
PAIRS = r"\b(\d+PR\s*#\d+SH?)\b"
NAMED_CABLE = r"(?i)\b(CAT[56]E?|MM\s*FIBER|SM\s*FIBER|COAX)\b"
CABLE_LABEL = r"\b([A-Z]+\d*\.\d{2}-[A-Z]\d+\.[A-Z]+)\b"
TERMINAL = r"\b(T[SB]\d+-\d+)\b"
BLOCK_TERMINAL = r"\bTB(\d+)-(\d+)\b"
STRIP_TERMINAL = r"\bTS(\d+)-(\d+)\b"
DRAWING_REF = r"\b(E[CPS]-\d{3}\.\d)\b"
SHEET_REF = r"\b(NRE-E[CP]-\d{3}\.\d)\b"
SIGNAL_WORDS = ("TRIP", "CLOSE", "OPEN", "SCADA", "BF TRIP", "LOCKOUT", "ALARM", "BLOCK", "INITIATE", "TRANSFER", "INTERLOCK", "METERING", "STATUS", "CONTROL", "POWER", "AUX")
TITLE_WORDS = ("DRAWN BY", "DESIGNED BY", "REVIEWED BY", "DATE", "PROJECT", "DRAWING", "ENGINEER", "STAMP")

DRAWING_TYPES = ("ONE_LINE", "AC_SCHEMATIC", "DC_SCHEMATIC", "PANEL_WIRING", "CABLE_WIRING", "PANEL_LAYOUT", "SYSTEM_DIAGRAM", "DRAWING_INDEX", "RELAY_FUNCTIONAL", "LEGEND", "COMMUNICATION", "UNKNOWN")
#: Words of a title, in the order of the partial match.
TITLE_TYPES = (
    ("ONE LINE", "ONE_LINE"),
    ("ONE-LINE", "ONE_LINE"),
    ("ONELINE", "ONE_LINE"),
    ("AC SCHEMATIC", "AC_SCHEMATIC"),
    ("AC ELEMENTARY", "AC_SCHEMATIC"),
    ("DC SCHEMATIC", "DC_SCHEMATIC"),
    ("DC ELEMENTARY", "DC_SCHEMATIC"),
    ("PANEL WIRING", "PANEL_WIRING"),
    ("WIRING DIAGRAM", "PANEL_WIRING"),
    ("CABLE WIRING", "CABLE_WIRING"),
    ("CABLE", "CABLE_WIRING"),
    ("PANEL LAYOUT", "PANEL_LAYOUT"),
    ("LAYOUT", "PANEL_LAYOUT"),
    ("SYSTEM DIAGRAM", "SYSTEM_DIAGRAM"),
    ("DRAWING INDEX", "DRAWING_INDEX"),
    ("INDEX", "DRAWING_INDEX"),
    ("RELAY FUNCTIONAL", "RELAY_FUNCTIONAL"),
    ("FUNCTIONAL", "RELAY_FUNCTIONAL"),
    ("LEGEND", "LEGEND"),
    ("COMMUNICATION", "COMMUNICATION"),
    ("COMM", "COMMUNICATION"),
)
#: First number of a drawing id, from and to, and the type.
NUMBER_SERIES = (
    (1, 2, "DRAWING_INDEX"),
    (100, 104, "ONE_LINE"),
    (110, 111, "RELAY_FUNCTIONAL"),
    (120, 122, "COMMUNICATION"),
    (200, 261, "AC_SCHEMATIC"),
    (300, 380, "DC_SCHEMATIC"),
    (400, 410, "PANEL_WIRING"),
    (500, 557, "CABLE_WIRING"),
    (600, 625, "PANEL_LAYOUT"),
    (700, 711, "SYSTEM_DIAGRAM"),
)
#: Parameter, component types, drawing types from the strongest.
AUTHORITY_RULES = (
    ("voltage_rating", ("*",), ("ONE_LINE", "AC_SCHEMATIC", "DC_SCHEMATIC", "PANEL_WIRING")),
    ("current_rating", ("*",), ("ONE_LINE", "AC_SCHEMATIC", "DC_SCHEMATIC")),
    ("power_rating", ("*",), ("ONE_LINE",)),
    ("impedance", ("*",), ("ONE_LINE",)),
    ("ratio", ("CT", "PT", "VT", "CCVT"), ("ONE_LINE", "AC_SCHEMATIC")),
    ("cable_specification", ("*",), ("DC_SCHEMATIC", "CABLE_WIRING", "PANEL_WIRING")),
    ("terminal_assignment", ("*",), ("DC_SCHEMATIC", "PANEL_WIRING")),
    ("relay_settings", ("RELAY", "50", "51", "21", "67", "81", "87"), ("DC_SCHEMATIC", "AC_SCHEMATIC")),
)
CRITICAL_PARAMETERS = ("voltage_rating", "current_rating", "power_rating")
WARNING_PARAMETERS = ("impedance", "ratio", "cable_specification")
PROTECTIVE = ("50", "51", "87", "21", "67", "81")
DC_SUPPLIED = ("50", "51", "87", "21", "67", "81", "52", "86", "RELAY", "RTAC", "CLOCK", "PDC", "NETSW", "RTR", "DFR", "LTC")

#: Word in a block's name, component type, description.
BLOCK_WORDS = (
    ("FUSE", "FU", "Fuse"),
    ("POWER SUPPLY", "BAT", "Power supply"),
    ("POWERSTRIP", "PS", "Power strip"),
    ("POWER STRIP", "PS", "Power strip"),
    ("GROUND", "GND", "Ground connection"),
    ("GND", "GND", "Ground connection"),
    ("SERIAL", "UNKNOWN", "Serial communication port"),
    ("ETHERNET", "UNKNOWN", "Ethernet communication port"),
    ("FIBER", "UNKNOWN", "Fiber optic port"),
    ("HAND SWITCH", "HS", "Hand switch"),
    ("HANDSWITCH", "HS", "Hand switch"),
    ("DFR", "DFR", "Digital fault recorder"),
    ("FAULT RECORDER", "DFR", "Digital fault recorder"),
    ("LTC", "LTC", "Load tap changer"),
    ("TAP CHANGER", "LTC", "Load tap changer"),
    ("METER", "METER", "Metering device"),
    ("RTAC", "RTAC", "Real-time automation controller"),
    ("CLOCK", "CLOCK", "GPS clock"),
    ("GPS", "CLOCK", "GPS clock"),
    ("PDC", "PDC", "Phasor data concentrator"),
    ("CISCO", "NETSW", "Network switch"),
    ("ROUTER", "RTR", "Network router"),
    ("MONITOR", "UNKNOWN", "HMI monitor"),
    ("KEYBOARD", "UNKNOWN", "HMI keyboard"),
    ("ATS", "ATS", "Automatic transfer switch"),
    ("TRANSFER SWITCH", "ATS", "Automatic transfer switch"),
    ("RTU", "RTAC", "Remote terminal unit"),
    ("HVAC", "UNKNOWN", "HVAC unit"),
    ("BATTERY BANK", "BAT", "Battery bank"),
    ("BATTERY CHARGER", "BAT", "Battery charger"),
    ("CHARGER", "BAT", "Battery charger"),
    ("INVERTER", "BAT", "Inverter"),
    ("BUSHING", "PT", "Bushing potential device"),
    ("ARRESTER", "MOV", "Surge arrester"),
    ("LIGHTNING", "MOV", "Lightning arrester"),
    ("TESLA", "RELAY", "TESLA controller"),
    ("UPS", "UPS", "Uninterruptible power supply"),
    ("MCC", "MCC", "Motor control center"),
    ("SWITCHGEAR", "SWGR", "Switchgear"),
    ("SWGR", "SWGR", "Switchgear"),
    ("VFD", "VFD", "Variable frequency drive"),
    ("PLC", "PLC", "Programmable logic controller"),
    ("RECTIFIER", "RECT", "Rectifier"),
    ("MOV", "MOV", "Metal oxide varistor"),
    ("SURGE", "SPD", "Surge protective device"),
    ("SPD", "SPD", "Surge protective device"),
    ("REGULATOR", "REG", "Voltage regulator"),
    ("GENERATOR", "GEN", "Generator"),
    ("MOTOR", "UNKNOWN", "Motor"),
)
DEVICE_TAGS = ("DEVICE", "RELAY_MODEL", "RELAY_TYPE")
FUSE_TAGS = ("FUSE_NUM", "FUSE_ID")
OUTPUT_TAGS = ("OUTPUT-#", "OUTPUT_NUM", "OUTPUT")
POWER_TAGS = ("PWR_SUP", "POWER_SUPPLY", "PWR")
CONSUMABLE_WORDS = ("CRIMP TERMINAL", "THHN", " SIS,", " SIS ", "WIRE ", "SPRING NUT", "STRUT", "ROD WITH MOUNTING", "CHANNEL", "MINI STRUT")
DESCRIPTIONS = {
    "52": "AC circuit breaker",
    "50": "Instantaneous overcurrent relay",
    "51": "Time overcurrent relay",
    "86": "Lockout relay",
    "87": "Differential protective relay",
    "89": "Disconnect switch",
    "21": "Distance relay",
    "25": "Synchronizing check device",
    "27": "Undervoltage relay",
    "59": "Overvoltage relay",
    "67": "Directional overcurrent relay",
    "81": "Frequency relay",
    "79": "AC reclosing relay",
    "CT": "Current transformer",
    "PT": "Potential transformer",
    "VT": "Voltage transformer",
    "CCVT": "Coupling capacitor voltage transformer",
}

#: Words of a sheet's header row, and beginnings of nameplate lines that name a place.
HEADER_WORDS = ("ITEM", "QTY", "QUANTITY", "MATERIAL", "CATALOG", "DESCRIPTION", "DEVICE", "SIZE", "DRAWING", "DWG")
PLACES = ("34.5kV", "138kV", "NORTH", "SOUTH", "EAST", "H-FRAME", "NE ", "SW ", "NW ", "SE ")

#: What a sheet cell's text is told by.
CELL_COMPONENT = r"\b(?:52|50|51|86|87|89|21|25|27|59|67|81)-[A-Z0-9]|SEL-\d+|CT-|PT-|VT-|CCVT-|FU\d+|BAF-\d+|TB\d+|TS\d+|SW-\d+|RTAC|CLOCK|PDC|DFR|FPP|DPAC"
CELL_VALUE = r"\d+\s*(?:kV|V|A|kA|MVA)"
CELL_CABLE = r"\d+/C\s*#\d+"

#: Tags of title blocks and the fields they fill.
TITLE_TAGS = (("DWGNO", "drawing_number"), ("DWGTYPE", "drawing_type"), ("CURRREV", "revision"), ("DRWNBY", "drawn_by"), ("DSGNBY", "designed_by"), ("APPDBY", "reviewed_by"), ("ORGDATE", "date"))
