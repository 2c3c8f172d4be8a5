"""Fixed schemas of the tables."""

OBJECT = "gmlid string, building_gmlid string, class_gmlid string, polygon_gmlid string"
OBJECT_CLASS = "id long, object_type string, gmlid string, building_gmlid string, class_gmlid string, polygon_gmlid string"
VOXEL = "id long, voxel_position long, vox_geom binary, gmlid string, building_gmlid string, class_gmlid string, polygon_gmlid string"
TABLES = {"object": OBJECT, "object_class": OBJECT_CLASS, "voxel": VOXEL}
SIDECAR = "building_id string, class_gml_id string, polygon_gml_id string, thematic_role string, class string"
CSV_COLUMNS = ("voxel_position", "vox_geom", "gmlid", "building_gmlid", "class_gmlid", "polygon_gmlid", "object_type", "X", "Y", "Z")
TILE_STATUS = "tile string, attempt int, ts timestamp, status string, error string, batch string"
TILE_FILES = "tile string, path string, late boolean, batch string"
