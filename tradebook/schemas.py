"""Table and document schemas."""

from __future__ import annotations

from dataclasses import dataclass

# Table layouts, document fields and defaults.
CUSTOMERS = (
    "id long, tenant_id long, name string, stage string, data_json string, "
    "created_at timestamp, updated_at timestamp"
)
JOBS = (
    "id long, tenant_id long, customer_id long, title string, status string, "
    "data_json string, created_at timestamp, updated_at timestamp"
)
SINGLETON = "tenant_id long, data_json string, updated_at timestamp"
DELIVERIES = (
    "seq long, tenant_id long, received_at timestamp, content_type string, raw_text string"
)
SEND_RESULTS = (
    "job_id long, booking_id string, kind string, status string, message_id string, error string"
)
UPLOADS = (
    "container string, filename string, content_type string, data_base64 string, "
    "received_at timestamp"
)

DEFAULT_STAGE = "New Enquiry"
DEFAULT_STATUS = "Book Survey"
SECTORS = ("Retail", "Trade", "Commercial")

_MARK = "struct<status: string, sentAt: string>"
BOOKING = (
    f"struct<id: string, date: string, fitter: string, emailSent: {_MARK}, reminderSent: {_MARK}>"
)
TABS = (
    "struct<"
    f"survey: struct<date: string, fitter: string, notes: string, notifyEnabled: boolean, "
    f"emailSent: {_MARK}, reminderSent: {_MARK}>, "
    f"installation: struct<date: string, fitters: array<string>, fittersNotes: string, "
    f"startTime: string, notifyEnabled: boolean, bookedEmailSent: {_MARK}, "
    f"emailReminders: struct<week: {_MARK}, day: {_MARK}>, "
    f"deliveries: array<struct<id: string, supplier: string, date: string>>>, "
    f"serviceCall: struct<notes: string, notifyEnabled: boolean, bookings: array<{BOOKING}>>>"
)
# What the calendar shows of a job.
CALENDAR_TABS = (
    "struct<survey: struct<date: string, fitter: string>, "
    "installation: struct<date: string, fitters: array<string>, startTime: string>, "
    "serviceCall: struct<bookings: array<struct<id: string, date: string, fitter: string>>>>"
)
# What new bookings are told by. A mark blocks by being there, whatever it is, so it stays a VARIANT.
BOOKED_TABS = (
    "struct<survey: struct<date: string, fitter: string, notifyEnabled: boolean, emailSent: variant>, "
    "installation: struct<date: string, fitters: array<string>, notifyEnabled: boolean, "
    "bookedEmailSent: variant>, serviceCall: struct<notifyEnabled: boolean, "
    "bookings: array<struct<id: string, date: string, fitter: string, emailSent: variant>>>>"
)
SETTINGS_DOC = (
    "companyName string, companyPhone string, "
    "emailTemplates map<string, struct<subject: string, body: string, bcc: string>>, "
    "fitterPasswords map<string, string>"
)
MANUAL_ORDERS_DOC = "array<struct<id: string, supplier: string, date: string, reference: string>>"

# The tabs a record made from an event starts with.
EMPTY_TABS = """{
  "quote": {"files": [], "notes": ""},
  "invoices": {"files": [], "notes": ""},
  "notepad": {"text": ""},
  "survey": {"files": [], "images": [], "notes": "", "date": "", "fitter": ""},
  "orderConfirmation": {"files": [], "notes": ""},
  "bills": {"files": [], "costs": "", "notes": ""},
  "installation": {"date": "", "fitters": [], "fittersNotes": "", "startTime": "",
    "emailReminders": {"week": {"status": "pending", "sentAt": ""},
                       "day": {"status": "pending", "sentAt": ""}},
    "deliveries": []},
  "guarantee": {"files": [], "notes": ""},
  "tasks": [],
  "serviceCall": {"notes": "", "officePhotos": [], "bookings": []}
}"""


@dataclass(frozen=True)
class LinkFields:
    """Document keys that tie a record to a project of the external quoting system.

    Name the keys your documents use; `source` is the origin written on leads made from events.
    """

    ref: str = "externalRef"
    status: str = "externalStatus"
    modified: str = "externalModifiedAt"
    source: str = "Quoting system"

    def customer_doc(self) -> str:
        return (
            "name string, email string, email2 string, phone string, address string, "
            "source string, stage string, sector string, quoteValue string, "
            f"installationValue string, {self.ref} string, {self.status} string, "
            f"{self.modified} string"
        )

    def job_doc(self) -> str:
        return (
            "title string, status string, reference string, quoteValue string, "
            f"installationValue string, {self.ref} string, {self.status} string, "
            f"{self.modified} string, wonAt string, tabs {TABS}"
        )


LINK = LinkFields()
