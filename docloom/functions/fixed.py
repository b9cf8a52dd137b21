"""Values that results depend on: phrases, font thresholds, aliases, known products. All are defaults of parameters."""

#: Phrases that mark boilerplate in short texts.
BOILERPLATE = ("Help Guide", "Copyright", "Sony Corporation", "All rights reserved")
#: What lines are ignored for.
IGNORED_EQUAL = ("Help Guide",)
IGNORED_START = ("Interchangeable Lens", "Copyright")
IGNORED_CONTAINS = ("Sony Corporation",)

#: Least font sizes of topics, sections and subheaders, and the size below which a line is a footnote, by model
#: prefix; the first prefix that fits counts.
PROFILES = (
    ("ILME-FR7", {"topic": 11.0, "section": 9.8, "subheader": 8.6, "footnote": 8.4}),
    ("ILCE", {"topic": 12.0, "section": 10.5, "subheader": 9.5, "footnote": 8.5}),
    ("ILME", {"topic": 11.5, "section": 10.0, "subheader": 9.0, "footnote": 8.5}),
    ("", {"topic": 11.5, "section": 10.0, "subheader": 9.0, "footnote": 8.5}),
)

#: Models that share a guide, and the product it is filed under.
ALIASES = {"PXW-Z200": "PXW-Z200, HXR-NX800", "HXR-NX800": "PXW-Z200, HXR-NX800"}

#: Products with guides, in listing order.
KNOWN_PRODUCTS = (
    "BRC-AM7", "DSC-RX0M2", "ILCE-1", "ILCE-1M2", "ILCE-6700", "ILCE-7C", "ILCE-7CM2", "ILCE-7CR", "ILCE-7M4", "ILCE-7RM4",
    "ILCE-7RM4A", "ILCE-7RM5", "ILCE-7SM3", "ILCE-9M2", "ILCE-9M3", "ILME-FR7", "ILME-FX2", "ILME-FX3", "ILME-FX30", "ILME-FX3A",
    "ILX-LR1", "PXW-Z200, HXR-NX800", "ZV-E1", "ZV-E10M2",
)

#: Header texts that the validator counts as artefacts.
FILE_MAXIMUM = ("FileMaximum",)
MODE_DIAL = ("Mode dialDescription", "Mode dialExposure")
