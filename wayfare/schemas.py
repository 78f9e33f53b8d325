"""Schemas of the stored relations, as DDL."""

EVENTS = "dataset_name string, time double, node long, x double, y double, z double"
DATASETS = "dataset_name string, date_imported timestamp, coord_type int, complete_import boolean"
NODE_LISTS = "dataset_name string, node long"
ENCOUNTERS = "dataset_name string, distance double, experiment_name string, time double, node1 long, node2 long, duration float, x float, y float, z float, ppbr boolean"
ENCOUNTERED_NODES = "experiment_name string, node long, count long, first_encounter double"
MESSAGES = "id string, sender long, type int, destinationnode long, payload string, time double, shards int, shardid int, ms boolean, ttl_hops int, ttl_time long, lathops int, size float"
TRANSFERS = "experiment_name string, message_id string, sender_node long, reciever_node long, creation_time double, transfer_time double, path string, ttl_hops int, hops int, size double"
DELIVERED = "experiment_name string, message_id string, deliver_time double, creation_time double, path string, hops int, size double"
BANDWIDTHS = "experiment_name string, time double, node1 long, node2 long, bandwidth int, drops int"
EPOCH_LOADS = "experiment_name string, now double, prev double, load long, avg_load double"
RESULTS = "experiment_name string, lat_sec double, lat_hop double, max_band int, net_load long, throughput double, num_messages long, peak_load double, average_load double"
DISTRICTS = "dataset_name string, district_id int, x double, y double, z double"
PMG_EDGES = "experiment_name string, node_id long, district1 int, district2 int"
THRESHOLDS = "dataset string, node long, threshold double"
EXPERIMENTS = "experiment_name string, dataset_name string, investigator string, date_started timestamp, date_finished timestamp, distance_conditions string"
EXPERIMENT_FAMILIES = "family_dataset string, family_distance double, logic string, experiment_name string"
