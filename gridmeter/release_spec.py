"""Release specification of the source tables.

Fixed values: which columns each table drops (personal data, credentials,
free text) and which it pseudonymises, as published with the data set.
Names not present in a frame are ignored when applied.
"""

# ---- fixed values: columns dropped per table --------------------------------
DROP_COLS = {
    "customers": [
        "name1", "name2", "name3", "name", "phoneNumber",
        "customerStatus", "formFiller", "tags", "latestReading", "status",
    ],
    "meteringplatformtariffs": [],
    "minigridprojects": [
        "pvwattsDataSource", "pvwattsProductionAnnual", "pvwattsMonthlyAveragekWhProduced",
        "investors", "donors",
        "remoteMonitoringPlatform", "remoteMonitoringSiteId",
        "remoteMonitoringUrl", "remoteMonitoringAPIToken",
    ],
    "paymentconfirmations": [
        "businessShortCode", "transactionID", "invoiceNumber", "thirdPartyTransactionID",
        "phoneNumber", "firstName", "middleName", "lastName",
    ],
    "paymentvalidations": [
        "businessShortCode", "transactionID", "invoiceNumber", "thirdPartyTransactionID",
        "phoneNumber", "firstName", "middleName", "lastName",
    ],
    "sparkmetercustomers": [
        "meters_address", "meters_city", "meters_coords", "meters_country",
        "meters_street1", "meters_street2", "meters_tags",
        "name", "phoneNumber",
    ],
    "sparkmeterreadings": [
        "UncertainMetadata", "kilowattHoursPeriod", "organization",
        "meter_address_street1", "meter_address_street2", "meter_address_city",
        "meter_address_postalcode", "meter_address_state",
        "meter_customer_name", "meter_customer_phoneNumber",
    ],
    "sparkmetertransactions": [
        "UncertainMetadata", "referenceId", "externalId", "memo",
        "to_address_street1", "to_address_street2", "to_address_city",
        "to_address_state", "to_address_postalcode",
        "to_customer_name", "to_customer_phoneNumber", "to_name",
        "from_address_street1", "from_address_street2", "from_address_city",
        "from_address_state", "from_address_postalcode",
        "from_customer_name", "from_customer_phoneNumber", "from_name",
    ],
    "tariffs": [],
    "vrmgeneration": [],
}

# ---- fixed values: columns pseudonymised per table --------------------------
PSEUDO_COLS = {
    "customers": ["customerAccountNumber", "customerId"],
    "meteringplatformtariffs": [],
    "minigridprojects": [],
    "paymentconfirmations": ["customerAccountNumber"],
    "paymentvalidations": ["customerAccountNumber"],
    "sparkmetercustomers": ["id"],
    "sparkmeterreadings": [
        "meter_customer_id", "meter_customer_code", "meter_customer_code_backup",
    ],
    "sparkmetertransactions": [
        "to_customer_id", "to_customer_code", "to_customer_code_backup",
        "from_customer_id", "from_customer_code",
    ],
    "tariffs": [],
    "vrmgeneration": [],
}

# ---- fixed values: station columns safe to publish (allow list) -------------
STATION_SAFE_COLS = [
    "meteringSiteId", "meteringBaseStation", "projectName",
    "meteringPlatform", "meteringSiteStatus", "timezoneOffsetUtc",
    "olderMeteringSiteIds",
]

# ---- fixed values: generation sites left out of the release -----------------
EXCLUDED_GENERATION_SITES = ["UBA Acme, Ogba, Lagos, Nigeria", "Shell Oza 1"]

# Tables whose payments are cleaned after pseudonymisation.
PAYMENT_TABLES = ("paymentconfirmations", "paymentvalidations")
