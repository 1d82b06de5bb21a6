"""Fixed schemas. A property that a file lacks reads as null."""

XY = "struct<x:double,y:double>"
CLASSIFICATION = "name string, color array<int>"
FEATURE = "type string, id string, geometry struct<type:string,coordinates:string>, properties struct<objectType:string,name:string,classification:string>"
COLLECTION = "type string, features array<struct<type:string,id:string,geometry:struct<type:string,coordinates:string>,properties:struct<objectType:string,name:string,classification:string>>>"
#: One feature a line, with its place in the slide.
FEATURE_LINE = "slide_id string, ord long, type string, id string, geometry struct<type:string,coordinates:string>, properties struct<objectType:string,name:string,classification:string>"
#: Properties that an exported feature needs.
EXPORTED = ("id", "objectType", "classification", "geometry")
#: Rows and columns of the plates.
PLATES = {"384": (16, 24), "96": (8, 12)}
#: Red, green, blue, magenta, cyan, yellow: the palette's fixed values.
PALETTE = ((255, 0, 0), (0, 255, 0), (0, 0, 255), (255, 0, 255), (0, 255, 255), (255, 255, 0))
