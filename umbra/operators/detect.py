"""What the detectors share: the span's type, priorities, labels and word lists."""

from __future__ import annotations

SPAN = "struct<start:int,end:int,kind:string,value:string,detector:string,priority:int>"
#: Characters searched for a label on each side by default.
LABEL_WINDOW = 64

# fixed values: priorities of the built-in kinds
PRIORITY = {
    "SECRET": 100, "TRAVEL_DOCUMENT_MRZ": 99, "SESSION_TOKEN": 98, "URL_CREDENTIALS": 95, "IBAN": 90, "EU_VAT_ID": 88, "CREDIT_CARD": 85, "DEVICE_ID": 84,
    "ICD_CODE": 83, "MEDICATION": 82, "GERMAN_TAX_ID": 80, "SOCIAL_SECURITY_ID": 79, "ID_CARD_NUMBER": 78, "PASSPORT_NUMBER": 78, "HEALTH_INSURANCE_ID": 77,
    "GERMAN_TAX_NUMBER": 76, "EMAIL": 75, "COMMERCIAL_REGISTER_ID": 74, "DRIVER_LICENCE_ID": 73, "BANK_ACCOUNT": 72, "IPV6": 70, "IPV4": 65, "MAC": 62,
    "BIC": 60, "POSTAL_ADDRESS": 59, "DATE_OF_BIRTH": 58, "PHONE": 55, "VEHICLE_PLATE": 52, "POSTCODE": 48, "LITERAL": 1000,
}
CUSTOM_PRIORITY, DICTIONARY_PRIORITY = 45, 40
# fixed values: labels that license a bare identifier
LABELS = {
    "mac": ("MAC", "BSSID", "hwaddr", "Hardware-Adresse", "Netzwerkadresse", "physical address", "Ethernet"),
    "uuid": ("UUID", "GUID", "Geräte-ID", "Gerätekennung", "Device ID", "Advertising ID", "IDFA", "IDFV", "Installations-ID", "Instanz-ID"),
    "document": ("Ausweis", "Ausweisnr", "Personalausweis", "Passnr", "Reisepass", "Pass-Nr", "Ausweis-Nr"),
    "kvnr": ("KVNR", "Versichertennr", "Versichertennummer", "eGK", "Krankenversichertennummer", "Vers.-Nr"),
    "tax number": ("Steuernummer", "St.-Nr", "StNr", "Steuer-Nr", "Steuernr"),
    "licence": ("Führerschein", "Fuehrerschein", "FS-Nr", "Führerscheinnummer", "Fahrerlaubnis"),
    "icd": ("ICD", "ICD-10", "Diagnose", "Diagnosis"),
    "postcode": ("PLZ", "Postleitzahl", "Postcode"),
    "plate": ("Kennzeichen", "Nummernschild"),
    "account": ("Kto", "Konto", "Kontonr", "Kontonummer", "Konto-Nr", "Kontoverbindung", "Account", "Account number", "Acct"),
    "routing": ("Routing", "Routing number", "ABA", "ABA number", "RTN"),
    "bic": ("BIC", "SWIFT"),
    "phone": ("Tel", "Telefon", "Mobil", "Handy", "Fax", "Festnetz", "Rufnummer", "Durchwahl", "anruf", "erreichbar", "phone", "cell", "call", "hotline", "toll free", "Kontakt", "contact"),
    "address": ("Anschrift", "Adresse", "Postanschrift", "Hausanschrift", "Lieferanschrift", "Rechnungsanschrift", "wohnhaft", "Wohnort", "Firmensitz", "Geschäftssitz", "Standort"),
}
# fixed values: words that clear a session token, and cookie or header names that carry one
CLEARING = "deleted|expired|invalid|none|null|nil|true|false|undefined"
SESSION_NAMES = "session|sessionid|session_id|sid|phpsessid|jsessionid|asp\\.net_sessionid|connect\\.sid|csrftoken|xsrf-token|auth_token|access_token|refresh_token|id_token|x-auth-token|x-api-key"
