"""Schemas of the files and messages that the sources read."""

from __future__ import annotations

from pyspark.sql import types as T

GTFS: dict[str, str] = {
    "agency": "agency_id string, agency_name string, agency_url string, agency_timezone string, agency_lang string",
    "stops": "stop_id string, stop_code string, stop_name string, stop_lat double, stop_lon double, location_type smallint, parent_station string, platform_code string, level_id string, stop_timezone string, wheelchair_boarding smallint",
    "routes": "route_id string, agency_id string, route_short_name string, route_long_name string, route_type smallint, route_color string, route_text_color string",
    "trips": "route_id string, service_id string, trip_id string, trip_headsign string, trip_short_name string, direction_id smallint, block_id string, shape_id string, wheelchair_accessible smallint, bikes_allowed smallint",
    "stop_times": "trip_id string, arrival_time string, departure_time string, stop_id string, stop_sequence int, stop_headsign string, pickup_type smallint, drop_off_type smallint, timepoint smallint",
    "calendar": "service_id string, monday smallint, tuesday smallint, wednesday smallint, thursday smallint, friday smallint, saturday smallint, sunday smallint, start_date string, end_date string",
    "calendar_dates": "service_id string, date string, exception_type smallint",
    "frequencies": "trip_id string, start_time string, end_time string, headway_secs int, exact_times smallint",
    "shapes": "shape_id string, shape_pt_lat double, shape_pt_lon double, shape_pt_sequence int",
    "transfers": "from_stop_id string, to_stop_id string, transfer_type smallint, min_transfer_time int",
    "feed_info": "feed_publisher_name string, feed_lang string, feed_start_date string, feed_end_date string, feed_version string",
    "translations": "table_name string, field_name string, language string, translation string, record_id string, field_value string",
}

TRIP_UPDATES = (
    "feed_id string, entity_id string, header_ts long, trip_id string, route_id string, start_date date, start_time string, schedule_relationship string, delay int, vehicle_id string, vehicle_label string, timestamp long, "
    "stop_time_update array<struct<stop_sequence:int,stop_id:string,arrival:struct<time:long,delay:int>,departure:struct<time:long,delay:int>,schedule_relationship:string,platform:string>>"
)
VEHICLE_POSITIONS = "feed_id string, entity_id string, header_ts long, vehicle_id string, vehicle_label string, lat float, lon float, bearing float, speed float, trip_id string, route_id string, route_type smallint, start_date date, start_time string, timestamp long"
ALERTS = (
    "alert_id string, header map<string,string>, description map<string,string>, cause int, effect int, url map<string,string>, active_period array<struct<start:long,end:long>>, "
    "informed_entity array<struct<agency_id:string,route_id:string,route_type:int,stop_id:string,trip_id:string,direction_id:int>>"
)
RAW_MESSAGES = "feed_id string, kind string, fetched_ms long, body binary"
IP_RANGES = "ip_range_start string, ip_range_end string, country_code string, state string, state2 string, city string, postcode string, latitude double, longitude double, timezone string"


def struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)
