"""Schemas of the files that jobs read; nothing is inferred."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, DoubleType, MapType, StringType, StructField, StructType


def strings(*names: str) -> StructType:
    return StructType([StructField(n, StringType()) for n in names])


# The columns read of each timetable table, all text.
GTFS = {
    "agency": strings("agency_id", "agency_name"),
    "routes": strings("route_id", "agency_id", "route_type"),
    "trips": strings("trip_id", "route_id", "service_id", "trip_long_name", "trip_short_name"),
    "stops": strings("stop_id", "stop_name", "stop_lat", "stop_lon", "parent_station", "platform_code", "zone_id"),
    "stop_times": strings("trip_id", "stop_sequence", "stop_id", "arrival_time", "departure_time", "pickup_type", "drop_off_type"),
    "transfers": strings("from_trip_id", "to_trip_id", "from_stop_id", "to_stop_id", "transfer_type"),
    "calendar_dates": strings("service_id", "date", "exception_type"),
    "feed_info": strings("feed_version", "feed_start_date", "feed_end_date"),
}

_REF = StructType([StructField("_ref", StringType())])
STOP_PLACE = StructType(
    [
        StructField("_id", StringType()),
        StructField("privateCodes", StructType([StructField("PrivateCode", StringType())])),
        StructField("Name", StringType()),
        StructField("TransportMode", StringType()),
        StructField("placeEquipments", StructType([StructField("LiftEquipment", ArrayType(StructType([StructField("_id", StringType()), StructField("PublicCode", StringType()), StructField("Description", StringType())])))])),
        StructField(
            "quays",
            StructType(
                [
                    StructField(
                        "Quay",
                        ArrayType(
                            StructType(
                                [
                                    StructField("_id", StringType()),
                                    StructField("PublicCode", StringType()),
                                    StructField("QuayType", StringType()),
                                    StructField("ParentQuayRef", _REF),
                                    StructField("AccessibilityAssessment", StructType([StructField("limitations", StructType([StructField("AccessibilityLimitation", StructType([StructField("StepFreeAccess", StringType())]))]))])),
                                    StructField("equipmentPlaces", StructType([StructField("EquipmentPlace", ArrayType(StructType([StructField("placeEquipments", StructType([StructField("LiftEquipmentRef", ArrayType(_REF))]))])))])),
                                ]
                            )
                        ),
                    )
                ]
            ),
        ),
    ]
)

LOG = StructType([*strings("received", "envelope", "delivery_ts", "facility", "status", "start", "end").fields])
PLACES = StructType([StructField("elements", ArrayType(StructType([StructField("type", StringType()), StructField("id", StringType()), StructField("lat", DoubleType()), StructField("lon", DoubleType()), StructField("center", StructType([StructField("lat", DoubleType()), StructField("lon", DoubleType())])), StructField("tags", MapType(StringType(), StringType()))])))])
RECORD = StructType([StructField("v", StringType()), StructField("updated", StringType()), StructField("days", MapType(StringType(), StructType([StructField("yes", StringType()), StructField("no", StringType())])))])
CORRECTIONS = strings("ns_code", "track", "status", "reason", "source", "date")

# What a lift message and a journey message hold, without namespaces.
FACILITY_MESSAGE = "struct<HeartbeatNotification:struct<Status:string>,FacilityCondition:array<struct<FacilityRef:string,FacilityStatus:struct<Status:string>,ValidityPeriod:struct<StartTime:string,EndTime:string>>>>"
JOURNEY_MESSAGE = "struct<RitInfo:array<struct<TreinDatum:string,LogischeRit:array<struct<LogischeRitDeel:array<struct<LogischeRitDeelNummer:string,MaterieelDeel:array<struct<MaterieelDeelToegankelijk:string>>>>>>>>>"
