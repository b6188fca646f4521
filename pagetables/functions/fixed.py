"""Word lists, patterns and formats that decide the results.

Everything here is data. The rules that use these values are in the sibling
modules.
"""

# --- fixed values: record layouts -------------------------------------------

WIDE_FIELDS = [
    "parcel_number", "sale_price", "sale_date", "owner_name",
    "property_address", "municipality", "square_footage",
    "mail_address", "mail_city_state_zip", "homesteaded",
    "acres", "lot_size", "zoning",
    "property_value", "assessed_value", "market_value", "taxable_value",
    "year_built", "bedrooms", "bathrooms", "half_baths",
    "property_type", "property_use", "building_class",
    "account_number", "folio_number", "deed_book",
    "neighborhood", "subdivision", "land_use_code", "school_district",
    "tax_amount", "exemption_amount",
    "record_url", "additional_info", "extraction_date",
]

SALES_FIELDS = [
    "sale_price", "sale_date", "owner_name", "property_address",
    "municipality", "square_footage", "mail_address", "mail_city_state_zip",
    "homesteaded", "parcel_number", "property_value", "lot_size",
    "year_built", "property_type", "record_url", "extraction_date",
    "page_number",
]

# --- fixed values: header keywords, first field in this order wins -----------

FIELD_KEYWORDS = [
    ("property_address", ["address", "location", "street", "site address",
                          "property location", "situs"]),
    ("owner_name", ["owner", "name", "taxpayer", "owner name", "taxpayer name"]),
    ("mail_address", ["mailing", "mail", "mailing address", "owner address"]),
    ("mail_city_state_zip", ["mail city", "mail state", "mail zip",
                             "city state zip", "owner city"]),
    ("property_value", ["just value", "market value", "assessed", "assessment",
                        "total value"]),
    ("assessed_value", ["assessed", "assessed value", "assessment"]),
    ("market_value", ["market", "market value", "fair market"]),
    ("taxable_value", ["taxable", "taxable value", "net taxable"]),
    ("square_footage", ["sqft", "sq ft", "square", "footage", "building area",
                        "living area"]),
    ("lot_size", ["lot", "land", "lot size", "lot sqft", "land sqft", "lot area"]),
    ("acres", ["acres", "acreage", "acre"]),
    ("parcel_number", ["parcel", "pcn", "parcel id", "parcel number"]),
    ("account_number", ["account", "account number", "acct"]),
    ("folio_number", ["folio", "folio number"]),
    ("sale_price", ["sale", "sold", "price", "sale price", "last sale"]),
    ("sale_date", ["date", "sold date", "sale date", "last sale date"]),
    ("year_built", ["year built", "built", "construction", "year constructed"]),
    ("property_type", ["type", "property type", "class"]),
    ("property_use", ["use", "land use", "property use"]),
    ("municipality", ["city", "municipality", "jurisdiction"]),
    ("neighborhood", ["neighborhood", "district", "area"]),
    ("subdivision", ["subdivision", "subdiv", "plat"]),
    ("zoning", ["zone", "zoning"]),
    ("land_use_code", ["land use", "use code", "luc"]),
    ("building_class", ["class", "building class", "bldg class"]),
    ("bedrooms", ["bed", "br", "bedroom", "bedrooms"]),
    ("bathrooms", ["bath", "bathroom", "ba", "full bath"]),
    ("half_baths", ["half bath", "half", "powder"]),
    ("tax_amount", ["tax", "taxes", "tax amount", "annual tax"]),
    ("homesteaded", ["homestead", "homestead exempt", "homesteaded"]),
    ("exemption_amount", ["exempt", "exemption", "exempt amount"]),
]

# --- fixed values: column headings of the wide CSV ---------------------------

FRIENDLY_HEADINGS = {
    "parcel_number": "Parcel Number", "sale_price": "Sale Price",
    "sale_date": "Sale Date", "owner_name": "Owner Name",
    "property_address": "Property Address", "municipality": "Municipality",
    "square_footage": "Square Footage", "mail_address": "Mail Address",
    "mail_city_state_zip": "Mail City State Zip", "homesteaded": "Homesteaded",
    "acres": "Acres", "lot_size": "Lot Size", "zoning": "Zoning",
    "property_value": "Property Value", "assessed_value": "Assessed Value",
    "market_value": "Market Value", "taxable_value": "Taxable Value",
    "year_built": "Year Built", "bedrooms": "Bedrooms",
    "bathrooms": "Bathrooms", "half_baths": "Half Baths",
    "property_type": "Property Type", "property_use": "Property Use",
    "building_class": "Building Class", "account_number": "Account Number",
    "folio_number": "Folio Number", "deed_book": "Deed Book",
    "neighborhood": "Neighborhood", "subdivision": "Subdivision",
    "land_use_code": "Land Use Code", "school_district": "School District",
    "tax_amount": "Tax Amount", "exemption_amount": "Exemption Amount",
    "record_url": "Record URL", "additional_info": "Additional Info",
    "extraction_date": "Extraction Date",
}

# --- fixed values: words looked for in cells and texts -----------------------

RESULTS_TABLE_WORDS = ["property", "address", "owner", "value", "parcel", "account"]
TEXT_BLOCK_WORDS = ["palm beach", "parcel", "property", "owner", "address", "value"]
RESULT_ROW_TEXT = "PALM BEACH"
DETAIL_LINK_WORDS = ["property", "parcel", "detail"]

STREET_TOKENS = ["ST", "AVE", "BLVD", "RD", "LN", "CT", "DR", "WAY", "PL"]
STREET_TOKENS_SHORT = ["ST", "AVE", "BLVD", "RD", "LN", "CT", "DR"]
COMPACT_STREET_TOKENS = [
    "ST", "AVE", "RD", "DR", "LN", "CT", "PL", "WAY", "BLVD", "CIR",
    "DRIVE", "ROAD", "STREET", "AVENUE", "LANE", "COURT", "PLACE",
    "BOULEVARD", "CIRCLE",
]
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun",
          "jul", "aug", "sep", "oct", "nov", "dec"]

CELL_OWNER_CITIES = ["PALM BEACH", "WEST PALM", "BOCA", "DELRAY", "BOYNTON",
                     "WELLINGTON", "JUPITER"]
CELL_TOWN_CITIES = ["PALM BEACH", "WEST PALM", "BOCA", "DELRAY", "BOYNTON"]
TEXT_OWNER_CITIES = ["PALM BEACH", "WEST PALM", "BOCA RATON", "DELRAY BEACH",
                     "BOYNTON BEACH", "WELLINGTON", "JUPITER"]

MIN_SQFT, MAX_SQFT = 500, 50000
MAX_PAGE_NUMBER = 1000
MAX_PAGES = 50
EMPTY_RUN = 3
BLOCKS_PER_PAGE = 50
BLOCK_MIN_CHARS = 50
INFO_CHARS = 300

# --- fixed values: ordered patterns of the wide record -----------------------
# (field, [(pattern, text put before the first group)])

WIDE_PATTERNS = {
    "property_address": [
        r"(\d+\s+[A-Z\s]+(?:ST|AVE|RD|DR|LN|CT|PL|WAY|BLVD|CIR)"
        r"(?:\s+(?:APT|UNIT|STE)\s*[\w\d]+)?)",
        r"(\d+\s+[A-Z][A-Z\s]+[A-Z](?:\s+(?:STREET|AVENUE|ROAD|DRIVE|LANE|COURT"
        r"|PLACE|WAY|BOULEVARD|CIRCLE)))",
    ],
    "parcel_number": [
        r"([0-9]{2}-[0-9]{4}-[0-9]{3}-[0-9]{4})",
        r"PCN[:\s]*([A-Z0-9\-]+)",
        r"Parcel[:\s]*([A-Z0-9\-]+)",
    ],
    "property_value": [
        r"Just Value[:\s]*\$([0-9,]+)",
        r"Market Value[:\s]*\$([0-9,]+)",
        r"Total Value[:\s]*\$([0-9,]+)",
    ],
    "acres": [
        r"([0-9]+\.?[0-9]*) acre[s]?",
        r"Acres?[:\s]*([0-9]+\.?[0-9]*)",
        r"([0-9]+\.?[0-9]*) ac",
    ],
    "mail_city_state_zip": [
        r"([A-Z\s]+,\s*[A-Z]{2}\s+[0-9]{5}(?:-[0-9]{4})?)",
        r"Mail.*?([A-Z\s]+,\s*[A-Z]{2}\s+[0-9]{5})",
        r"Owner.*?([A-Z\s]+,\s*FL\s+[0-9]{5})",
    ],
    "homesteaded": [
        r"Homestead[:\s]*(Yes|No|Y|N)",
        r"Homesteaded[:\s]*(Yes|No|Y|N)",
        r"(Homestead Exemption)",
        r"(Yes).*?homestead",
        r"(No).*?homestead",
    ],
    "lot_size": [
        r"Lot Size[:\s]*([0-9,]+)\s*sq\s*ft",
        r"Land Area[:\s]*([0-9,]+)",
        r"([0-9,]+)\s*sq\s*ft\s*lot",
    ],
}
WIDE_TOWN_TEXT, WIDE_TOWN = "palm beach", "Palm Beach"

# --- fixed values: ordered patterns of the sales record ----------------------
# Repeated groups are possessive so that a long run of words cannot exhaust the
# regex engine's stack; each word ends at a word boundary, so the match is the
# one a backtracking group would find.

SALES_PRICE = r"\$[\d,]+\.?\d*"
SALES_DATES = [
    r"\b\d{1,2}/\d{1,2}/\d{4}\b",
    r"\b\d{1,2}-\d{1,2}-\d{4}\b",
    r"\b\d{4}-\d{1,2}-\d{1,2}\b",
    r"\b[A-Za-z]{3}\s+\d{1,2},?\s+\d{4}\b",
]
SALES_ADDRESSES = [
    r"\b\d+\s+[A-Za-z\s]+(?:St|Street|Ave|Avenue|Blvd|Boulevard|Rd|Road|Ln|Lane"
    r"|Ct|Court|Dr|Drive|Way|Pl|Place)\b",
    r"\b\d+\s+[A-Z][A-Za-z\s]+\s+(?:ST|AVE|BLVD|RD|LN|CT|DR|WAY|PL)\b",
]
SALES_OWNER_COMMA = r"\b[A-Z][a-z]++,\s*+[A-Z][a-z]++\b(?:\s++[A-Z][a-z]++\b)*+"
SALES_OWNER_WORDS = r"\b[A-Z][a-z]++\s++[A-Z][a-z]++\b(?:\s++[A-Z][a-z]++\b)*+"
SALES_OWNER_CAPS = r"\b[A-Z][A-Z\s]+[A-Z]\b"
SALES_TOWNS = (r"\b(Palm Beach|West Palm Beach|Boca Raton|Delray Beach"
               r"|Boynton Beach|Wellington|Jupiter|Lake Worth)\b")
SALES_TOWN_WORDS = r"\b[A-Z][a-z]++\b(?:\s++[A-Z][a-z]++\b)*+"
SALES_SQFT = r"\b([1-9]\d{2,4})\b"
SALES_PARCELS = [
    r"\b[A-Z0-9]{2,3}-[0-9]{2,4}-[0-9]{2,4}\b",
    r"\b\d{2}-\d{2}-\d{2}-\d{2,5}\b",
    r"\b[A-Z0-9]{10,15}\b",
]
SALES_HOMESTEAD = r"\b(Y|N|Yes|No|TRUE|FALSE)\b"

DATE_FORMATS = ["M/d/yyyy", "M-d-yyyy", "yyyy-M-d", "MMM d, yyyy", "MMM d yyyy"]

# --- fixed values: page furniture --------------------------------------------

PAGE_OF = r"(?:Page\s+)?(\d+)\s+of\s+(\d+)"
PAGE_SLASH = r"(?<![\d/])(\d+)\s*/\s*(\d+)(?![\d/])"
TEXT_BLOCK_SPLIT = r"\n\s*\n|\t\t+|_{3,}|-{3,}"
SAMPLE_FIELDS = ["property_address", "owner_name", "property_value",
                 "square_footage", "municipality", "year_built",
                 "sale_price", "sale_date"]
