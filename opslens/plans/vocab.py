"""Action names and tokens the reports filter on."""
from __future__ import annotations

# Audit actions counted as query activity.
QUERY_ACTIONS = ("commandFinish", "runCommand", "commandSubmit", "queries", "databricksSqlPermissionsDenied")

# Audit actions that read a table (users panel).
TABLE_ACCESS_ACTIONS = ("getTable", "getTableData", "commandFinish")

# Audit actions that read a table (catalog panel).
TABLE_READ_ACTIONS = ("getTable", "getTableData")

# Audit actions that change grants or ownership.
PERMISSION_ACTIONS = ("updatePermissions", "grantPermissions", "revokePermissions", "changeOwner")

# Audit actions recording a denied access.
DENIAL_ACTIONS = ("databricksSqlPermissionsDenied", "unauthorizedAccess", "accessDenied")

# Audit actions recording a schema change.
DDL_ACTIONS = (
    "createTable",
    "deleteTable",
    "alterTable",
    "createSchema",
    "deleteSchema",
    "addColumns",
    "dropColumns",
    "renameColumn",
)

# Column-name fragments that suggest personal data.
PII_TOKENS = (
    "email",
    "phone",
    "mobile",
    "ssn",
    "social_security",
    "dob",
    "birth_date",
    "passport",
    "national_id",
    "tax_id",
    "credit_card",
    "card_number",
    "salary",
    "iban",
    "address",
    "postcode",
    "zipcode",
    "gender",
    "race",
    "religion",
)

# Run and statement states.
FAILED, SUCCEEDED, FINISHED = "FAILED", "SUCCEEDED", "FINISHED"
BASE_TABLE = "BASE TABLE"
OWNERSHIP = "OWNERSHIP"
